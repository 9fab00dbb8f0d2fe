"""Plain versions of what the operators compute, for small tables."""

import hashlib
import heapq
import math
import re
import zlib
from collections import defaultdict

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def left_of(docs: dict[int, bytes], length: int = 100) -> dict[int, tuple]:
    """(bytes, removed, spans, what stays) per document when strings that start earlier too are removed."""
    seen, out = set(), {}
    for d in sorted(docs):
        body, gone = docs[d], bytearray(len(docs[d]))
        for i in range(len(body) - length + 1):
            key = body[i : i + length]
            if key in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(key)
        left = bytes(b for b, g in zip(body, gone) if not g)
        spans = sum(g and (not i or not gone[i - 1]) for i, g in enumerate(gone))
        out[d] = (len(body), sum(gone), spans, hashlib.sha256(left).hexdigest())
    return out


def shingles(text: str | None, words: int) -> set:
    own = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(_LOWER))
    return {tuple(own[i : i + words]) for i in range(max(1, len(own) - words + 1))} if own else set()


def groups(docs: dict[int, str | None], words: int, percent: int = 80) -> dict[int, int]:
    sets = {d: shingles(t, words) for d, t in docs.items()}
    top = {d: d for d in docs}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(docs)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b]:
                same = len(sets[a] & sets[b])
                if 100 * same >= percent * (len(sets[a]) + len(sets[b]) - same):
                    x, y = find(a), find(b)
                    top[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def benchmark_words(text: str | None) -> list[str]:
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(_LOWER))


def hits(docs: dict[int, str | None], items: list[tuple], window: int = 10) -> dict[int, tuple]:
    """(words, hit words, items) per document."""
    windows: dict[tuple, set] = {}
    for item, text in items:
        w = benchmark_words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    sizes = {len(w) for w in windows}
    out = {}
    for d, text in docs.items():
        w, hit, named = benchmark_words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    named |= windows[tuple(w[i : i + n])]
        out[d] = (len(w), len(hit), sorted(str(x) for x in named if x is not None))
    return out


def rebuilt(convs: dict[int, list[tuple]]) -> dict[int, tuple]:
    """Turns of each conversation after its first ones are replaced by those of another."""
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = tuple(convs.get(c - c % 5, [])[:h] + own[h:])
    return out


def trie(seqs: dict[int, tuple]) -> set[tuple]:
    members, kids, leaves, saved = defaultdict(list), defaultdict(int), defaultdict(int), defaultdict(int)
    for c in sorted(seqs):
        for d in range(len(seqs[c]) + 1):
            members[seqs[c][:d]].append(c)
    for k in members:
        if k:
            kids[k[:-1]] += 1
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1].encode()) if k else 0
    return {
        (m[0], len(k), members[k[:-1]][0] if k else None, len(m), kids[k], leaves[k], saved[k], hashlib.sha256(",".join(str(c) for c in m if len(seqs[c]) == len(k)).encode()).hexdigest())
        for k, m in members.items()
    }


# --- fixed values: white space, and the grammar of role initials as a table of states ---
WHITE = " \t\n\x0b\x0c\r"
GRAMMAR = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
# ---


def cheapest(rows: list[tuple[str, str, str]]) -> tuple[int, str, tuple]:
    """Least cost, then least audit, of (role, text, fault) rows, by search over all edits."""
    heap, done = [(0, "", 0, 0, ())], set()
    while True:
        cost, audit, i, state, lines = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in (0, 3):
            return cost, audit, lines
        to, name = ("a", "assistant") if state == 2 else ("u", "user")
        heapq.heappush(heap, (cost + 2, audit + "I", i, GRAMMAR[state][to], lines + ((name, ""),)))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, lines))
            if fault not in ("blank", "duplicate"):
                late = int(fault == "truncated")
                if role[:1] in GRAMMAR[state]:
                    heapq.heappush(heap, (cost + late, audit + "K", i + 1, GRAMMAR[state][role[:1]], lines + ((role, text),)))
                heapq.heappush(heap, (cost + 2 + late, audit + "R", i + 1, GRAMMAR[state][to], lines + ((name, text),)))


def repaired(rows: list[tuple]) -> tuple:
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, digest) of (turn, role, text) rows in order."""
    seen, out = set(), []
    for _, role, text in rows:
        fault = "blank" if not text.strip(WHITE) else "duplicate" if (role, text) in seen else "truncated" if text.rstrip(WHITE)[-1] not in ".!?" else ""
        out.append((role, text, fault))
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    kinds = [x[2] for x in out]
    cost, audit, lines = cheapest(out)
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *map(kinds.count, ("blank", "duplicate", "truncated")),
        sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(out, out[1:])), cost, audit,
        hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest(),
    )


def damaged(conv: int | None, rows: list[tuple]) -> list[tuple]:
    out = []
    for turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        harm = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if harm:
            text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
            out += [(turn, "user" if harm == 4 else role, text)] * (2 if harm == 3 else 1)
    return out


def segmentations(word: bytes, pieces: dict[bytes, float], longest: int = 64) -> float:
    """Natural logarithm of the sum, over all segmentations, of the product of their pieces' weights."""
    ways = [0.0]
    for j in range(1, len(word) + 1):
        parts = [ways[i] + math.log(pieces[word[i:j]]) for i in range(max(0, j - longest), j) if pieces.get(word[i:j])]
        most = max(parts, default=-math.inf)
        ways.append(most + math.log(sum(math.exp(p - most) for p in parts)) if parts else most)
    return ways[-1]
