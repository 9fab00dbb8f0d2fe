"""Curation, sinks, lookups and audits on small inputs and on disturbed telemetry."""

import base64
import json

import pytest
from pyspark.sql import functions as F

from checks import base
from promptlens import fixed_values as V
from promptlens.functions import detectors as D
from promptlens.functions import hashing as H
from promptlens.operators import audit as A
from promptlens.operators import curate as C
from promptlens.operators import deidentify as Deid
from promptlens.operators import enrich as E
from promptlens.operators import judge as J
from promptlens.operators import ledger
from promptlens.operators.ledger import append_once
from promptlens.plans import reports as R
from promptlens.session import scratch_path
from promptlens.sources import dimensions as Dim
from promptlens.sources import logs as L
from tests.test_plans import nodes, output


def envelope(event_id, entry):
    text = entry if isinstance(entry, str) else json.dumps(entry)
    return event_id, base64.b64encode(text.encode()).decode()


def frame(spark, rows):
    return spark.createDataFrame(rows, "event_id string, data string")


ENTRY = {
    "insertId": "a", "timestamp": "2026-01-02T03:04:05.678Z", "trace": "projects/p/traces/t1", "spanId": "s",
    "jsonPayload": {
        "interaction_type": V.CHAT, "employee_name": "Ann Lee", "employee_email": "ann@x.example",
        "department": "Operations", "prompt_text": "Find the file of Bo Ray, SSN: 000-12-3456", "pillar": "HR",
        "connectors_queried": ["Jira_Quality_CAPA"], "latency_ms": 5, "prompt_tokens": "6", "response_tokens": 7,
    },
}


def test_one_row_in_full(spark):
    key = base.test_key(spark)
    row = C.curate(frame(spark, [envelope("m1", ENTRY)]), D.default_detectors(["Bo Ray"]), key).first()
    assert row.prompt_text_masked == "Find the file of [PERSON_NAME], SSN: ***-**-3456"
    assert row.agent_tree_path == "GE_Chat_Window -> Jira_Quality_CAPA"
    assert (row.trace_id, row.dlp_risk_level, row.is_shadow_prompt, row.prompt_tokens) == ("t1", "HIGH", True, 6)
    assert row.employee_role == "Unknown" and row.topic_cluster == ""
    assert "Ann" not in str(row) and "ann@" not in str(row)


def test_sparse_and_broken_entries(spark):
    sparse = {"timestamp": ENTRY["timestamp"], "jsonPayload": {}}
    no_payload = {"timestamp": ENTRY["timestamp"]}
    junk = json.loads(json.dumps(ENTRY)) | {"insertId": "j"}
    junk["jsonPayload"]["latency_ms"] = "soon"
    rows = [
        envelope("m1", sparse), envelope("m2", no_payload), envelope("m3", "{not json"), ("m4", ""), ("m5", None),
        ("m6", "***"), envelope("m7", {"jsonPayload": {}}), envelope("m8", junk),
    ]
    df = frame(spark, rows)
    out = {r.insert_id: r for r in C.curate(df, base.DETECTORS, base.test_key(spark)).collect()}
    assert set(out) == {"m1", "m2"}
    assert out["m1"].anonymous_actor_hash == "usr_anonymous"
    assert out["m1"].interaction_type == V.AGENT and out["m1"].root_agent == ""
    good, bad = L.quarantine_malformed(df)
    assert {r.event_id for r in bad.collect()} == {"m3", "m6"}
    assert set(bad.columns) == {"event_id", "data_length", "data_sha256", "reason"}
    flat = C.masked_rows(good, base.DETECTORS, base.test_key(spark))
    reasons = {r.insert_id: r.reason for r in C.require_not_null(flat)[1].collect()}
    assert reasons == {"m7": "missing or invalid event_timestamp", "j": "missing or invalid latency_ms"}


def test_redelivery_keeps_the_first(spark):
    later = ENTRY | {"timestamp": "2026-01-02T03:04:06.000Z"}
    df = frame(spark, [envelope("m2", later), envelope("m1", ENTRY), envelope("m3", later)])
    rows = C.curate(df, base.DETECTORS, base.test_key(spark)).collect()
    assert len(rows) == 1 and rows[0].event_timestamp.microsecond == 678000


def test_hot_id_and_hot_actor(spark):
    """A third of all rows share one id, and one actor sends most of the rest."""
    rows = [envelope(f"m{i}", ENTRY | {"insertId": "hot" if i % 3 == 0 else f"id{i}"}) for i in range(600)]
    out = C.curate(frame(spark, rows), base.DETECTORS, base.test_key(spark))
    assert out.count() == 401
    assert A.run_counters(out).first().unique_actors == 1


def test_append_is_idempotent_and_overwrite_replaces(spark, sf):
    path = scratch_path(spark, "t")
    rows = C.curate(base.messages(spark, sf), base.DETECTORS, base.test_key(spark))
    assert append_once(rows, path) == 1000
    assert append_once(rows.limit(10), path) == 0
    assert C.read_curated(spark, path).count() == 1000
    C.write_curated(base.curated(spark, sf).where("event_date = '2024-01-03'").drop("event_date"), path)
    dates = [r.d for r in C.read_curated(spark, path).select(F.col("event_date").cast("string").alias("d")).distinct().collect()]
    assert dates == ["2024-01-03"]


def test_judges_are_exchangeable(spark, sf):
    from checks.judging import stub_factory

    out, bad = C.curate_judged(base.messages(spark, sf), base.DETECTORS, base.test_key(spark), stub_factory(), scratch_path(spark, "judged"))
    assert out.columns == base.curated(spark, sf).drop("event_date").columns
    refused = {r.insert_id for r in bad.collect()}
    accepted = {r.insert_id for r in out.collect()}
    assert refused and accepted and not refused & accepted and len(refused | accepted) == 1000


def test_whole_minutes_may_have_a_point(spark, sf):
    from checks.judging import stub_factory

    rows = J.judge_with(base.masked(spark, sf).limit(20), stub_factory())
    pointed = rows.withColumn("judge_json", F.regexp_replace("judge_json", r'("estimated_manual_minutes": ?[0-9]+)', "$1.0"))
    halves = rows.withColumn("judge_json", F.regexp_replace("judge_json", r'("estimated_manual_minutes": ?[0-9]+)', "$1.5"))
    want = sorted(r.insert_id for r in J.validate_judge(rows)[0].collect())
    assert sorted(r.insert_id for r in J.validate_judge(pointed)[0].collect()) == want
    assert J.validate_judge(halves)[0].count() == 0


def test_an_append_that_broke_off_is_settled(spark, sf, monkeypatch):
    """Before its rows arrived, or after: the next append of the same rows leaves each id once."""
    key = base.test_key(spark)
    rows = C.curate(base.messages(spark, sf), base.DETECTORS, key)
    for arrived in (False, True):
        path = scratch_path(spark, "t")
        append_once(rows.limit(100), path)
        with monkeypatch.context() as patch:
            def fails(df, target, mode):
                if arrived:
                    C.write_curated(df, target, mode)
                raise OSError("lost the connection")

            patch.setattr(ledger, "write_curated", fails)
            with pytest.raises(OSError):
                append_once(rows, path)
        assert len(ledger.open_appends(spark, path)) == 1
        append_once(rows, path)
        table = C.read_curated(spark, path)
        assert table.count() == table.select("insert_id").distinct().count() == 1000
        assert not ledger.open_appends(spark, path)


def test_append_to_a_table_of_a_batch_load(spark, sf):
    path = scratch_path(spark, "t")
    C.write_curated(base.curated(spark, sf).drop("event_date"), path)
    assert append_once(C.curate(base.messages(spark, sf), base.DETECTORS, base.test_key(spark)), path) == 0


def test_the_stored_table_has_its_descriptions(spark, sf):
    path = scratch_path(spark, "t")
    C.write_curated(C.curate(base.messages(spark, sf), base.DETECTORS, base.test_key(spark)), path)
    described = {f.name: f.metadata.get("comment") for f in C.read_curated(spark, path).schema}
    assert sum(bool(x) for x in described.values()) == 40 and described["trace_id"] == "Trace id, last path segment only"


def test_bad_then_good_delivery(spark):
    junk = json.loads(json.dumps(ENTRY))
    junk["jsonPayload"]["latency_ms"] = "soon"
    loose = json.loads(json.dumps(ENTRY)) | {"insertId": "b", "resource": "global"}
    loose["jsonPayload"] |= {"latency_ms": 12.7, "prompt_tokens": 1240.0, "response_tokens": "1.5"}
    invalid = ("m4", base64.b64encode(b'{"insertId": "c\xff"}').decode())
    later = ENTRY | {"timestamp": "2026-01-02T03:05:00.000Z"}
    df = frame(spark, [envelope("m1", junk), envelope("m2", later), envelope("m3", loose), invalid])
    rows, bad = C.curate_and_reject(df, base.DETECTORS, base.test_key(spark))
    assert [(r.insert_id, r.latency_ms) for r in rows.collect()] == [("a", 5)]
    assert {(r.event_id, r.reason) for r in bad.collect()} == {
        ("m1", "missing or invalid latency_ms"), ("m3", "missing or invalid response_tokens"), ("m4", "malformed")
    }
    loose["jsonPayload"]["response_tokens"] = "2"
    row = C.curate(frame(spark, [envelope("m3", loose)]), base.DETECTORS, base.test_key(spark)).first()
    assert (row.latency_ms, row.prompt_tokens, row.response_tokens) == (12, 1240, 2)


def test_roster_join_takes_masked_rows_and_unique_ids(spark):
    key = base.test_key(spark)
    roster = spark.createDataFrame([(f"E{i}",) + ("x",) * 7 for i in range(5)], Dim.ROSTER)
    rows = spark.createDataFrame([("E1", "raw")], "employee_id string, prompt_text string")
    with pytest.raises(ValueError, match="de-identify"):
        E.enrich_employee(rows, roster, key)
    joined = E.enrich_employee(rows.drop("prompt_text"), roster, key)
    assert joined.first().employee_role == "x" and "employee_id" not in joined.columns
    with pytest.raises(Exception, match="employee_key twice in the roster"):
        E.enrich_employee(rows.drop("prompt_text"), roster.union(roster.limit(1)), key).collect()
    for node in nodes(joined):
        if "Exchange" in node.nodeName():
            assert not output(node) & {"employee_id", "employee_email", "employee_name"}


def test_roster_array_file(spark, tmp_path):
    file = tmp_path / "r.json"
    file.write_text(json.dumps([{"employee_id": "E1", "role": "Lead"}, {"employee_id": "E2"}], indent=1))
    rows = Dim.read_roster(spark, str(file)).orderBy("employee_id").collect()
    assert [(r.employee_id, r.role) for r in rows] == [("E1", "Lead"), ("E2", None)]


def test_catalog(spark):
    rows = {r.agent_num: r for r in Dim.agent_catalog(spark).collect()}
    assert len(rows) == 10
    assert rows[6].tree_path == [V.ROUTER, rows[5].id, rows[6].id]
    assert rows[8].tree_path == [V.ROUTER, rows[8].id]


def test_read_streams_options(spark, tmp_path):
    for name in ("chat", "agent"):
        (tmp_path / name).write_text(json.dumps(ENTRY) + "\nnot json\n")
    paths = {n: str(tmp_path / n) for n in ("chat", "agent")}
    both = L.read_streams(spark, paths)
    assert {r.log_name for r in both.collect()} == {V.CHAT_STREAM, V.AGENT_STREAM}
    assert both.where(L.is_corrupt(F.col("entry"))).count() == 2
    assert L.read_streams(spark, paths, "agent").count() == 2
    with pytest.raises(ValueError):
        L.read_streams(spark, paths, "mail")


def test_audits_report_what_is_wrong(spark):
    table = spark.createDataFrame(
        [("SSN 000-12-3456 a@b.example", "low", 5), ("clean", "high", 40)],
        "prompt_text_masked string, task_complexity string, estimated_manual_minutes long",
    )
    left = {r.info_type: r.remaining for r in A.residual_pii_audit(table).collect()}
    assert left == {V.SSN: 1, V.EMAIL: 1}
    wrong = {r.task_complexity: r.mismatches for r in A.minutes_consistency_audit(table).collect()}
    assert wrong == {"low": 0, "high": 1}
    pairs = spark.createDataFrame([("a", "h"), ("b", "h"), ("a", "h"), ("c", "k")], "employee_email string, anonymous_actor_hash string")
    assert tuple(A.actor_bijection_audit(pairs).first()) == (3, 2, 1)


def test_unknown_level_is_left_out_of_the_index(spark, sf):
    table = base.curated(spark, sf).withColumn(
        "specification_maturity",
        F.struct(
            F.when(F.col("pillar") == "HR", "other").otherwise(V.LEVEL_3).alias("level"),
            F.lit(None).cast("boolean").alias("is_search_query_style"),
        ),
    )
    for r in R.workforce_maturity(table).collect():
        assert r.workforce_maturity_index_1_to_3 in (3.0, None)
        assert r.search_query_habit_pct == 0.0


def test_approximate_performance_is_close(spark, sf):
    exact = {(r.interaction_type, r.leaf_agent, r.metric): r for r in R.performance_summary(base.curated(spark, sf)).collect()}
    for r in R.performance_summary(base.curated(spark, sf), approximate=True).collect():
        want = exact[r.interaction_type, r.leaf_agent, r.metric]
        assert (r.prompts, r.mean, r.max) == (want.prompts, want.mean, want.max)


def test_any_sample_belongs_to_the_group(spark, sf):
    story = R.incident_story(base.curated(spark, sf), sample="any")
    assert story.where("sample_masked_prompt IS NULL").count() == 0


def test_custom_detector_and_likelihood(spark):
    badge = D.custom("BADGE", "BDG-[0-9]{4}", "UNLIKELY")
    text = spark.createDataFrame([("see BDG-1234",)], "t string")
    types = lambda ds: text.select(D.info_types(F.col("t"), ds).alias("x")).first().x
    assert types([badge]) == ["BADGE"]
    assert types(D.min_likelihood([badge])) == []
    assert text.select(D.mask_text(F.col("t"), [badge]).alias("m")).first().m == "see [BADGE]"
    with pytest.raises(ValueError):
        D.custom("X", "x", "SURE")
    for unknown in ("mask", "mask_account", D.MASK_SSN):
        with pytest.raises(ValueError):
            D.custom("X", "x", transform=unknown)
    card = D.custom("CARD", "[0-9]{4}(?:-[0-9]{4}){3}", transform=D.MaskCharacters(12, "#", "-"))
    masked = text.select(D.mask_text(F.lit("a 1234-5678-9012-3456, b 1111-2222-3333-4444"), [card]).alias("m")).first().m
    assert masked == "a ####-####-####-3456, b ####-####-####-4444"
    whole = D.custom("BADGE", "BDG-[0-9]{4}", transform=D.MaskCharacters())
    assert text.select(D.mask_text(F.col("t"), [whole]).alias("m")).first().m == "see ********"


def test_dictionary_table_of_terms_of_any_length(spark):
    terms = spark.createDataFrame(
        [("Cher", V.PERSON), ("Ann Lee", V.PERSON), ("Bo van Dyk", V.PERSON), ("sprain", V.MEDICAL), ("rotator cuff tear", V.MEDICAL)], "term string, info_type string"
    )
    rows = spark.createDataFrame([(1, "Cher met Ann Lee's doctor: Rotator cuff tear, sprain."), (2, "Bo van Dyk"), (3, "Ann Leeds and Cheryl")], "id long, t string")
    found = Deid.find_dictionary_terms(rows, "id", "t", terms)
    assert {(r.id, r.term) for r in found.collect()} == {(1, "Cher"), (1, "Ann Lee"), (1, "rotator cuff tear"), (1, "sprain"), (2, "Bo van Dyk")}
    detectors = D.dictionary_detectors(terms)
    masked = [r.m for r in rows.orderBy("id").select(D.mask_text(F.col("t"), detectors).alias("m")).collect()]
    assert masked == ["[PERSON_NAME] met [PERSON_NAME]'s doctor: Rotator cuff tear, sprain.", "[PERSON_NAME]", "Ann Leeds and Cheryl"]
    exchanges = [x for x in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in x]
    assert not any("SinglePartition" in x for x in exchanges)
    assert Deid.find_dictionary_terms(rows, "id", "t", terms.limit(0)).count() == 0


def test_key_from_a_restricted_path(spark):
    path = scratch_path(spark, "keys")
    H.key_table(spark, b"k1", "2025").union(H.key_table(spark, b"k2", "2026")).write.parquet(path)
    df = spark.createDataFrame([("a@b.example",)], "e string")
    def of(table, k):
        return df.select(H.actor_hash(F.col("e"), H.ActorKey(table, k), 16).alias("h")).first().h

    keys = spark.read.parquet(path)
    assert of(keys, "2025") != of(keys, "2026") and len(of(keys, "2025")) == 20
    with pytest.raises(Exception, match="0 rows instead of one"):
        of(keys, "gone")
    with pytest.raises(Exception, match="2 rows instead of one"):
        of(keys.union(keys), "2025")


def test_a_hot_date_is_split_over_files(spark, sf):
    """Two thirds of all rows on one date: several files there, one for a small date."""
    time = F.col("event_timestamp")
    hot = F.when(F.pmod(F.xxhash64("insert_id"), F.lit(3)) > 0, F.lit("2024-03-01 00:00:00").cast("timestamp"))
    rows = base.curated(spark, sf).drop("event_date").withColumn("event_timestamp", F.coalesce(hot, time)).repartition(8)
    setting = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "32k")
    try:
        path = scratch_path(spark, "hot")
        C.write_curated(rows, path)
    finally:
        spark.conf.set(setting, before)
    files = C.read_curated(spark, path).groupBy("event_date").agg(
        F.countDistinct("_metadata.file_path").alias("files"), F.count("*").alias("rows")
    )
    by_date = {str(r.event_date): (r.files, r.rows) for r in files.collect()}
    assert by_date["2024-03-01"][0] > 1 and by_date["2024-03-01"][1] > 500
    assert sum(n for _, n in by_date.values()) == 1000


def test_texts_are_never_broadcast_to_a_dictionary(spark, monkeypatch):
    """A plan may take the texts for smaller than the dictionary: they are shuffled, or stay where they are."""
    terms = spark.createDataFrame([(f"Ann {c}lee", "PERSON_NAME") for c in "ABCDEFGH"], "term string, info_type string")
    rows = spark.createDataFrame([(1, "Ann Alee and Ann Blee")], "id int, t string")
    for most, how in ((8, "BuildRight"), (7, "SortMergeJoin")):
        monkeypatch.setattr(Deid, "SENT_TERMS", most)
        found = Deid.find_dictionary_terms(rows, "id", "t", terms)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert how in plan and "BuildLeft" not in plan
        assert {(r.id, r.term) for r in found.collect()} == {(1, "Ann Alee"), (1, "Ann Blee")}
