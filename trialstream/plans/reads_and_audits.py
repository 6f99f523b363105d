"""Registered queries of reads by position and of attribute audits, on documents with defects of every kind."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sources as S
from ..operators import audits as D
from ..operators import blocks as B
from ..operators import expect as X
from ..operators import stimuli as ST
from ..sources import indexed
from .registry import query, r
from .views import TRIALS, labelled, parts_of, table

# --- rows by position ------------------------------------------------------------------------------


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions that orders ask for, in order of their keys: repeated, and beyond the table's end."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), (F.col("o_custkey") * 11 % 1777 - 3).alias("row_index"))
    return indexed.numbered(o, ["key"])


_REQUESTS = "req AS (SELECT o_orderkey AS key, o_custkey * 11 % 1777 - 3 AS row_index, row_number() OVER (ORDER BY o_orderkey) - 1 AS position FROM orders)"


@query(f"""WITH {_REQUESTS} SELECT position, row_index, c_name, CASE WHEN row_index < 0 THEN 'invalid' WHEN c_custkey IS NULL THEN 'missing' ELSE 'found' END AS status FROM req LEFT JOIN customer ON c_custkey = row_index""")
def rows_by_position(spark, sf_dir):
    """Names at requested places, in the order of the request. A place is the stored key: rows of several files have no place in common."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row_index"), "c_name")
    return indexed.rows_at(rows, requests(spark, sf_dir), index="row_index").select("position", "row_index", "c_name", "status")


@query(f"""WITH {_REQUESTS}, h AS (SELECT position // 64 AS batch, position, list_sum(list_transform(embedding, lambda x: x::DOUBLE)) AS s FROM req JOIN embeddings ON vec_id = row_index) SELECT batch, count(*) AS n, round(sum(s), 4) AS total, min(position) AS first_position, max(position) AS last_position FROM h GROUP BY 1""")
def vectors_in_batches(spark, sf_dir):
    """Array values at requested places, which are stored keys, reduced in batches of 64 requests. Null values count for nothing; a total of nothing else is null."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_index"), F.array_compact("embedding").alias("embedding"))

    def reduce(frame: pd.DataFrame) -> pd.DataFrame:
        sums = [v.astype(float).sum() for v in frame["embedding"] if v is not None and len(v)]
        total = float(sum(sums)) if sums else None
        # a NaN would come back from pandas as null
        return pd.DataFrame({"n": [len(frame)], "total": [total], "is_nan": [total != total], "first_position": [frame["position"].iloc[0]], "last_position": [frame["position"].iloc[-1]]})

    out = indexed.batches_at(rows, requests(spark, sf_dir), reduce, "n bigint, total double, is_nan boolean, first_position bigint, last_position bigint")
    near = F.round("total", 4)
    # SQL's rounding keeps the sign of a zero
    total = F.when(F.col("is_nan"), float("nan")).when(near == 0, F.col("total") * 0).otherwise(near)
    return out.select("batch", "n", total.alias("total"), "first_position", "last_position")


# --- attributes ------------------------------------------------------------------------------------


def _document(when, k, segment, nation):
    """The text of a customer's document; when(divisor, then, otherwise) makes a conditional of either engine."""
    window = when(41, "'[0.15, 0.8]'", when(53, "'\"wide\"'", when(37, "'null'", when(59, "'[0.75, 0.15]'", "'[0.15, 0.75]'"))))
    subject = when(43, "'\"x\"'", f"'\"n' || {nation} || '\"'")
    session = when(47, f"'\"' || {k} || '\"'", f"CAST({k} AS STRING)")
    licks = when(31, "'{\"timestamps\": 10}'", when(17, "'{\"data\": 10}'", "'{\"timestamps\": 10, \"data\": 10}'"))
    running = when(29, "'{\"timestamps\": 20, \"data\": 19}'", "'{\"rate\": 60.0, \"data\": 20}'")
    eye = when(3, "''", "', \"eye\": {\"timestamps\": 5, \"data\": 5}'")
    whole = f"""'{{"task": {{"response_window_sec": ' || {window} || ', "mode": "' || {segment} || '"}}, "subject": {{"subject_id": ' || {subject} || '}}, "session_id": ' || {session} || ', "series": {{"licks": ' || {licks} || ', "running": ' || {running} || {eye} || '}}}}'"""
    return when(101, "'{\"task\": '", whole)


_TEXT = _document(lambda n, a, b: f"(CASE WHEN c_custkey % {n} = 0 THEN {a} ELSE {b} END)", "c_custkey", "c_mktsegment", "c_nationkey")
_DOCS = f"docs AS (SELECT c_custkey AS source, 'n' || c_nationkey AS subject, {_TEXT.replace('STRING', 'VARCHAR')} AS doc FROM customer), j AS (SELECT source, subject, CASE WHEN json_valid(doc) THEN doc::JSON END AS d FROM docs)"
CONTRACT = [
    D.Attribute("response_window", "$.task.response_window_sec", "array<double>", expected=(0.15, 0.75)), D.Attribute("mode", "$.task.mode"), D.Attribute("subject_id", "$.subject.subject_id", expected_column="subject"),
    D.Attribute("session_id", "$.session_id", "bigint", expected_column="source"), D.Attribute("eye_length", "$.series.eye.data", "bigint", required=False),
]
SIGNALS = [D.Signal("licks", "$.series.licks"), D.Signal("running", "$.series.running"), D.Signal("eye", "$.series.eye", required=False)]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("source"), F.concat(F.lit("n"), F.col("c_nationkey")).alias("subject"), F.expr(_TEXT).alias("doc"))


def _attribute_sql(name: str, path: str, kinds: str, wanted: str, missing: str = "missing") -> str:
    v = f"json_extract(d, '{path}')"
    return f"SELECT source, '{name}' AS attribute, CASE WHEN d IS NULL THEN 'unreadable' WHEN coalesce(json_type(d, '{path}'), 'NULL') = 'NULL' THEN '{missing}' WHEN json_type(d, '{path}') NOT IN ({kinds}) THEN 'wrong_type' WHEN {wanted.format(v=v)} THEN 'pass' ELSE 'differs' END AS status FROM j"


_AUDIT = " UNION ALL ".join([
    _attribute_sql("response_window", "$.task.response_window_sec", "'ARRAY'", "CAST({v} AS DOUBLE[]) = [0.15, 0.75]"), _attribute_sql("mode", "$.task.mode", "'VARCHAR'", "true"), _attribute_sql("subject_id", "$.subject.subject_id", "'VARCHAR'", "json_extract_string(d, '$.subject.subject_id') = subject"),
    _attribute_sql("session_id", "$.session_id", "'UBIGINT', 'BIGINT'", "CAST({v} AS BIGINT) = source"), _attribute_sql("eye_length", "$.series.eye.data", "'UBIGINT', 'BIGINT'", "true", "absent"),
])


@query(f"WITH {_DOCS} {_AUDIT}")
def attribute_audit(spark, sf_dir):
    """Every customer's document against a contract: a window, a mode, identities, an optional length."""
    return D.attribute_audit(documents(spark, sf_dir), CONTRACT, source="source", json="doc").select("source", "attribute", "status")


@query(f"""WITH {_DOCS}, whole AS ({_AUDIT}), a AS (SELECT * FROM whole WHERE source % 67 <> 0 UNION ALL SELECT * FROM whole WHERE source % 71 = 0)
 SELECT 'one_row' AS rule, count(*) - count(DISTINCT (source, attribute)) AS n_violations FROM a UNION ALL SELECT 'all_sources', count(*) FROM j WHERE source NOT IN (SELECT source FROM a) UNION ALL SELECT 'passes:' || attribute, count(*) FILTER (status NOT IN ('pass', 'absent')) FROM a GROUP BY attribute
 UNION ALL SELECT 'known_absences', (SELECT count(*) FROM (SELECT source FROM a WHERE status = 'absent' EXCEPT SELECT c_custkey FROM customer WHERE c_custkey % 6 = 0)) + (SELECT count(*) FROM (SELECT c_custkey FROM customer WHERE c_custkey % 6 = 0 EXCEPT SELECT source FROM a WHERE status = 'absent'))""")
def attribute_rules(spark, sf_dir):
    """Gates of an audit that lacks some sources and has others twice: coverage, failures by attribute, and absences other than those that are known."""
    docs = documents(spark, sf_dir)
    audit = D.attribute_audit(docs, CONTRACT, source="source", json="doc")
    audit = audit.where("source % 67 <> 0").unionByName(audit.where("source % 71 = 0"))
    absent = docs.where("source % 6 = 0").select("source", F.lit("eye_length").alias("attribute"))
    return D.audit_violations(audit, docs, source="source", by="attribute", known_absent=absent)


@query(f"""WITH {_DOCS}, t AS (SELECT unnest(['$.task', '$.task.response_window_sec', '$.task.mode', '$.subject', '$.subject.subject_id', '$.session_id', '$.series', '$.series.licks', '$.series.licks.timestamps', '$.series.licks.data', '$.series.running', '$.series.running.timestamps', '$.series.running.rate', '$.series.running.data', '$.series.eye', '$.series.eye.timestamps', '$.series.eye.data']) AS path),
 k AS (SELECT path, json_type(d, path) AS kind FROM j CROSS JOIN t WHERE d IS NOT NULL AND json_exists(d, path))
 SELECT path, CASE kind WHEN 'VARCHAR' THEN 'STRING' WHEN 'UBIGINT' THEN 'BIGINT' WHEN 'DOUBLE' THEN 'DECIMAL' WHEN 'NULL' THEN 'VOID' ELSE kind END AS kind, count(*) AS n FROM k GROUP BY 1, 2 UNION ALL SELECT '$', 'UNREADABLE', count(*) FROM j WHERE d IS NULL GROUP BY ALL HAVING count(*) > 0""")
def attribute_inventory(spark, sf_dir):
    """Every path of the documents with the kinds of its values."""
    return D.attribute_rows(documents(spark, sf_dir), source="source", json="doc").groupBy("path", "kind").agg(F.count("*").alias("n"))


def _signal_sql(name: str, required: bool) -> str:
    p = f"$.series.{name}"
    present = f"coalesce(json_type(d, '{p}'), '') = 'OBJECT'"
    return f"""SELECT source, '{name}' AS signal, {present} AS is_present, CASE WHEN {present} THEN CASE WHEN json_exists(d, '{p}.timestamps') THEN 'timestamps' WHEN json_exists(d, '{p}.rate') THEN 'rate' ELSE 'none' END END AS timing,
 CASE WHEN d IS NULL THEN 'unreadable' WHEN NOT {present} THEN '{'missing' if required else 'absent'}' WHEN NOT json_exists(d, '{p}.timestamps') AND NOT json_exists(d, '{p}.rate') THEN 'no_clock' WHEN NOT json_exists(d, '{p}.data') THEN 'missing_component'
 WHEN json_exists(d, '{p}.timestamps') AND CAST(json_extract(d, '{p}.timestamps') AS BIGINT) <> CAST(json_extract(d, '{p}.data') AS BIGINT) THEN 'length_mismatch' ELSE 'pass' END AS status FROM j"""


_SIGNALS = " UNION ALL ".join(_signal_sql(n, req) for n, req in (("licks", True), ("running", True), ("eye", False)))


@query(f"WITH {_DOCS}, j2 AS (SELECT source, d FROM j) {_SIGNALS}")
def signal_audit(spark, sf_dir):
    """Series of the documents: presence, components, lengths and how they keep time."""
    return D.signal_audit(documents(spark, sf_dir), SIGNALS, source="source", json="doc").select("source", "signal", F.coalesce("is_present", F.lit(False)).alias("is_present"), "timing", "status")


@query(f"""WITH {_DOCS}, a AS ({_SIGNALS}) SELECT signal, count(DISTINCT source) AS n_sources, count(*) FILTER (is_present) AS n_present, count(*) FILTER (status = 'pass') AS n_passing, count(*) FILTER (status NOT IN ('pass', 'absent')) AS n_failing, count(*) FILTER (status = 'unreadable') AS n_unreadable, count(*) FILTER (timing = 'timestamps') AS n_with_timestamps FROM a GROUP BY 1""")
def signal_coverage(spark, sf_dir):
    return D.signal_summary(D.signal_audit(documents(spark, sf_dir), SIGNALS, source="source", json="doc"), source="source")


# --- clocks ----------------------------------------------------------------------------------------

_CLOCKS = f"""{TRIALS}, pres AS (SELECT user_id AS source, event_id AS idx, epoch_us(CAST(ts AS TIMESTAMP)) / 1e6 - 1704067200.0 + 30 AS a, epoch_us(CAST(ts AS TIMESTAMP)) / 1e6 - 1704067200.0 + CASE WHEN user_id % 13 = 0 AND event_id % 5 = 0 THEN 30 ELSE 90 END AS b FROM events WHERE event_type IN ('view', 'click') AND user_id % 11 <> 0),
tc AS (SELECT source, min(start_time) AS s, max(stop_time) AS e, count(*) FILTER (stop_time <= start_time OR back OR same) = 0 AS ok FROM (SELECT *, start_time < lag(start_time) OVER (PARTITION BY source ORDER BY idx) AS back, count(*) OVER (PARTITION BY source, start_time) > 1 AS same FROM trials) GROUP BY 1),
pc AS (SELECT source, min(a) AS s, max(b) AS e, count(*) FILTER (b <= a OR back OR same) = 0 AS ok FROM (SELECT *, a < lag(a) OVER (PARTITION BY source ORDER BY a, idx) AS back, count(*) OVER (PARTITION BY source, a) > 1 AS same FROM pres) GROUP BY 1),
both_clocks AS (SELECT k.source, tc.s <= pc.e AND pc.s <= tc.e AS ranges_overlap, pc.s - tc.s AS start_offset, pc.e - tc.e AS stop_offset, coalesce(tc.ok, false) AS trial_passes, coalesce(pc.ok, false) AS presentation_passes FROM (SELECT DISTINCT user_id AS source FROM events) k LEFT JOIN tc USING (source) LEFT JOIN pc USING (source)),
passing AS (SELECT *, trial_passes AND presentation_passes AND coalesce(ranges_overlap, false) AS passes FROM both_clocks)"""


def clocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = labelled(spark, sf_dir)
    e = table(spark, sf_dir, "events")
    start = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - 1704067200.0
    shown = e.where(F.col("event_type").isin("view", "click") & (F.col("user_id") % 11 != 0)).select(F.col("user_id").alias("source"), (start + 30).alias("start_time"), (start + F.when((F.col("user_id") % 13 == 0) & (F.col("event_id") % 5 == 0), 30).otherwise(90)).alias("stop_time"))
    audits = [B.interval_clock(df, source="source", index=index, start="start_time", stop="stop_time") for df, index in ((t, "idx"), (shown, "start_time"))]
    return D.combined_clocks(*audits, t.select("source").distinct(), source="source", names=("trial", "presentation"))


@query(f"WITH {_CLOCKS} SELECT source, trial_passes, presentation_passes, ranges_overlap, round(start_offset, 3) AS start_offset, round(stop_offset, 3) AS stop_offset, passes FROM passing")
def combined_clocks(spark, sf_dir):
    """Clocks of trials and of presentations beside each other; some sessions have no presentations, some have empty ones."""
    no = F.lit(False)
    return clocks(spark, sf_dir).select("source", *[F.coalesce(f"{n}_passes", no).alias(f"{n}_passes") for n in ("trial", "presentation")], "ranges_overlap", *r("start_offset", "stop_offset", digits=3), "passes")


@query(f"""WITH {_CLOCKS}, k AS (SELECT count(*) AS n_sessions, count(*) FILTER (passes) AS a, count(*) FILTER (source % 4 <> 1) AS b FROM passing)
 SELECT e.event, e.scope, n_sessions, CASE e.scope WHEN 'intervals' THEN a WHEN 'frames' THEN b END AS n_passing, CASE WHEN e.scope = 'none' THEN 'not_audited' WHEN CASE e.scope WHEN 'intervals' THEN a ELSE b END = n_sessions THEN 'pass' ELSE 'fail' END AS status
 FROM (SELECT DISTINCT event_type AS event, CASE event_type WHEN 'view' THEN 'intervals' WHEN 'click' THEN 'intervals' WHEN 'error' THEN 'frames' ELSE 'none' END AS scope FROM events) e CROSS JOIN k""")
def event_dictionary(spark, sf_dir):
    """Kinds of events with what the audits they rest on say."""
    c = clocks(spark, sf_dir)
    scope = F.when(F.col("event_type").isin("view", "click"), "intervals").when(F.col("event_type") == "error", "frames").otherwise("none")
    events = table(spark, sf_dir, "events").select("event_type").distinct().select(F.col("event_type").alias("event"), scope.alias("scope"))
    aligned = c.select("source", (F.col("source") % 4 != 1).alias("passes"))
    return D.event_dictionary(events, c, aligned, source="source").select("event", "scope", "n_sessions", "n_passing", "status")


@query(f"""WITH {_CLOCKS} SELECT 'clock_passes' AS rule, count(*) FILTER (NOT passes) AS n_violations FROM passing UNION ALL SELECT 'one_row', 0::BIGINT UNION ALL SELECT 'all_sources', (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_custkey NOT IN (SELECT source FROM passing)) + (SELECT count(*) FROM passing WHERE source NOT IN (SELECT o_custkey FROM orders))""")
def clock_rules(spark, sf_dir):
    """The gate of the clocks, against customers with orders as expected sources."""
    c = clocks(spark, sf_dir)
    expected = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("source"))
    return X.all_of(X.expect_rows(c, {"clock_passes": F.col("passes")}), X.expect_unique(c, ["source"], "one_row"), X.expect_coverage(c, expected, ["source"], "all_sources"))


# --- stimuli -----------------------------------------------------------------------------------------


@query("""WITH im AS (SELECT l_suppkey AS source, l_orderkey * 10 + l_linenumber AS frame, l_linestatus = 'O' AS omitted, l_quantity <= 48 OR l_suppkey % 4 = 0 AS aligned, p_size, CASE WHEN l_suppkey % 4 <> 0 AND (l_orderkey * 10 + l_linenumber) % 103 = 0 THEN NULL ELSE 'im' || p_size END AS image, CASE WHEN p_size % 2 = 0 THEN 1.0 ELSE 0.7 END AS contrast FROM lineitem JOIN part ON l_partkey = p_partkey),
 s AS (SELECT *, 'im' || (source % 50 + 1) AS novel, CASE WHEN source % 5 = 0 THEN 0.7 ELSE 1.0 END AS nc, coalesce(image = novel, false) AS designated FROM im), l AS (SELECT *, CASE WHEN source % 4 <> 0 AND frame % 101 = 0 THEN NULL ELSE designated <> (source % 4 <> 0 AND frame % 97 = 0) END AS label FROM s),
 k AS (SELECT source, count(*) AS n_presentations, count(*) FILTER (NOT omitted) AS n_shown, count(*) FILTER (NOT omitted AND image IS NULL) AS n_unread_images, count(*) FILTER (NOT omitted AND image IS NULL) AS n_other_contrasts, count(*) FILTER (NOT omitted AND label IS NULL) AS n_missing_labels,
  count(*) FILTER (NOT omitted AND coalesce(label <> designated, true)) AS n_label_mismatches, count(*) FILTER (NOT omitted AND image IS NULL) AS n_missing_exposures, count(DISTINCT novel) AS n_novel_images, count(DISTINCT nc) AS n_novel_contrasts, bool_and(nc = 1.0) AS novel_is_full, count(*) FILTER (designated) AS n_designated, count(*) FILTER (NOT aligned) AS n_trial_mismatches FROM l GROUP BY 1)
 SELECT *, n_unread_images + n_other_contrasts + n_missing_labels + n_label_mismatches + n_missing_exposures + n_trial_mismatches = 0 AND n_novel_images = 1 AND n_novel_contrasts = 1 AND novel_is_full AND n_designated > 0 AS passes FROM k""")
def stimulus_semantics(spark, sf_dir):
    """Suppliers' presentations of parts: labels, contrasts and designations, with defects in three of four suppliers."""
    l, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    source, frame = F.col("l_suppkey"), F.col("l_orderkey") * 10 + F.col("l_linenumber")
    odd = source % 4 != 0
    token = F.when(odd & (frame % 103 == 0), "blank").otherwise(F.concat(F.lit("im"), F.col("p_size"), F.lit("_r-"), F.when(F.col("p_size") % 2 == 0, "1.0").otherwise("0.7")))
    rows = l.join(p, F.col("l_partkey") == F.col("p_partkey")).select(source.alias("source"), frame.alias("start_frame"), F.col("l_linenumber").alias("idx"), token.alias("image_name"), (F.col("l_linestatus") == "O").alias("omitted"), (F.col("l_quantity") <= 48).alias("small"))
    sessions = rows.select("source").distinct().select("source", F.concat(F.lit("im"), F.col("source") % 50 + 1).alias("novel_image"), F.when(F.col("source") % 5 == 0, 0.7).otherwise(1.0).alias("novel_contrast"))
    shown = S.task_presentations(rows, sessions, parts=parts_of(l))
    shown = shown.withColumn("exposure", F.when(F.col("image_id").isNotNull(), F.col("exposure")))
    odd, frame = F.col("source") % 4 != 0, F.col("start_frame")
    shown = shown.withColumn("is_image_novel", F.when(odd & (frame % 101 == 0), F.lit(None)).otherwise(F.col("is_designated_novel") != (odd & (frame % 97 == 0))))
    aligned = rows.select("source", (F.col("small") | (F.col("source") % 4 == 0)).alias("passes"))
    return ST.stimulus_semantics(shown, aligned, by=["source"])
