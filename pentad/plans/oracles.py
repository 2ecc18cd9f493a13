"""DuckDB SQL for the queries, written apart from them."""

from __future__ import annotations

FEATURES = [f"f{i}" for i in range(14)]
COLUMNS = ", ".join(FEATURES)


def _reference(x: str) -> str:
    v = f"(least(greatest({x}, -1), 1) * 10000.0)"
    return f"trunc({v} + CASE WHEN {v} >= 0 THEN 0.5 ELSE -0.5 END)::BIGINT"


def _request(x: str) -> str:
    return f"floor(least(greatest({x}, 0), 1) * 10000.0 + 0.5)::BIGINT"


def _distance(a: str, b: str, left="f", right="f") -> str:
    return " + ".join(f"({a}.{left}{i} - {b}.{right}{i}) * ({a}.{left}{i} - {b}.{right}{i})" for i in range(14))


REFS = "refs AS (SELECT vec_id AS ref_id, " + ", ".join(f"{_reference(f'embedding[{i + 1}]::DOUBLE')} AS f{i}" for i in range(14)) + ", CASE WHEN label >= 5 THEN 1 ELSE 0 END AS label FROM embeddings)"
QUERIES = "queries AS (SELECT ref_id AS query_id, * EXCLUDE (ref_id, label) FROM refs)"


def _votes(queries: str = "queries", refs: str = "refs") -> str:
    return f"""
        near AS (SELECT q.query_id, r.label, {_distance('q', 'r')} AS dist,
                        row_number() OVER (PARTITION BY q.query_id ORDER BY {_distance('q', 'r')}, r.ref_id) AS rn
                 FROM {queries} q CROSS JOIN {refs} r),
        votes AS (SELECT query_id, sum(label)::BIGINT AS fraud_count, CASE WHEN count(*) = 5 THEN max(dist) END AS worst
                  FROM near WHERE rn <= 5 GROUP BY query_id)"""


DECISIONS = "SELECT query_id, fraud_count, worst, fraud_count / 5.0::DOUBLE AS fraud_score, fraud_count < 3 AS approved FROM votes"
KNN = f"WITH {REFS}, {QUERIES}, {_votes()} {DECISIONS}"

TX = f"""
    e AS (SELECT *, CAST(round(value * 100) AS BIGINT) AS cents, epoch_us(ts) // 1000000 AS sec FROM events),
    w AS (SELECT *, (sum(cents) OVER (PARTITION BY user_id) / 5) / count(*) OVER (PARTITION BY user_id) AS customer_avg,
                 (sum(cents) OVER (PARTITION BY event_type) / 5) / count(*) OVER (PARTITION BY event_type) AS merchant_avg,
                 lag(sec) OVER (PARTITION BY user_id ORDER BY sec, event_id) AS last,
                 row_number() OVER (PARTITION BY user_id, event_type ORDER BY sec, event_id) AS nth,
                 count(*) OVER (PARTITION BY user_id ORDER BY sec RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) - 1 AS n24 FROM e),
    tx AS (SELECT event_id, {_request('(cents / 5) / 10000.0::DOUBLE')} AS f0, {_request('(1 + event_id % 12) / 12.0::DOUBLE')} AS f1,
                  {_request('((cents / 5) / customer_avg) / 10.0::DOUBLE')} AS f2, {_request('hour(ts) / 23.0::DOUBLE')} AS f3,
                  {_request('(isodow(ts) - 1) / 6.0::DOUBLE')} AS f4,
                  CASE WHEN last IS NULL THEN -10000 ELSE {_request('(sec // 60 - last // 60) / 1440.0::DOUBLE')} END AS f5,
                  CASE WHEN last IS NULL THEN -10000 ELSE {_request('((event_id * 37) % 1200) / 1000.0::DOUBLE')} END AS f6,
                  {_request('((event_id * 53) % 1500) / 1000.0::DOUBLE')} AS f7, {_request('n24 / 20.0::DOUBLE')} AS f8,
                  CASE WHEN event_id % 2 = 0 THEN 10000 ELSE 0 END AS f9, CASE WHEN event_id % 3 = 0 THEN 10000 ELSE 0 END AS f10,
                  CASE WHEN nth > 1 THEN 0 ELSE 10000 END AS f11,
                  CASE event_type WHEN 'click' THEN 1500 WHEN 'error' THEN 8500 WHEN 'purchase' THEN 2000 WHEN 'signup' THEN 4500 ELSE 3000 END AS f12,
                  {_request('merchant_avg / 10000.0::DOUBLE')} AS f13,
                  CASE WHEN event_type IN ('error', 'signup') AND value > 25 THEN 1 ELSE 0 END AS label, customer_avg <> 0 AS valid FROM w)"""
#: Distance and reference in one number, of which the five least are kept: all pairs would be too many rows to sort.
TX_SCORES = f"""WITH {TX}, keyed AS (SELECT q.event_id AS query_id, r.label, ({_distance('q', 'r')}) * 1073741824 + r.event_id AS key FROM tx q CROSS JOIN tx r),
    least AS (SELECT query_id, arg_min(label, key, 5) AS labels, min(key, 5) AS keys FROM keyed GROUP BY query_id),
    votes AS (SELECT query_id, coalesce(list_sum(labels), 0)::BIGINT AS fraud_count, (keys[5] // 1073741824)::BIGINT AS worst FROM least) {DECISIONS}"""


def _bucket(x: str, n: int) -> str:
    return f"CASE WHEN {x} <= 0 THEN 0 ELSE least({n - 1}, ({x} * {n}) // 10001) END"


def _flag(test: str) -> str:
    return f"CASE WHEN {test} THEN 1 ELSE 0 END"


PART = f"({_bucket('f7', 4)} + 4 * {_bucket('f2', 4)} + 16 * {_flag('f11 > 0')} + 32 * {_flag('f10 > 0')} + 64 * {_flag('f9 > 0')} + 128 * {_flag('f5 < 0')})"
PROFILE = " + ".join(
    f"(({x})::BIGINT << {shift})"
    for x, shift in (
        (_bucket("f2", 16), 0), (_bucket("f7", 8), 4), (_bucket("f8", 4), 7), (_bucket("f12", 4), 9), (_bucket("f0", 4), 11), (_flag("f5 < 0"), 13),
        (_flag("f9 > 0"), 14), (_flag("f10 > 0"), 15), (_flag("f11 > 0"), 16), (_bucket("f6", 4), 17), (_flag("f1 > 1000"), 19), (_bucket("f13", 4), 20),
    )
)


def _projection() -> str:
    bits = []
    for bit in (3, 2, 1, 0):
        for f in (2, 8, 12, 5, 7, 0, 13):
            bits.append(f"(((((least(greatest(f{f}, -10000), 10000) + 10000) * 15) // 20000) >> {bit}) & 1)")
    morton = " + ".join(f"({b}::BIGINT << {len(bits) - 1 - i})" for i, b in enumerate(bits))
    prefix = " + ".join(f"({_flag(t)}::BIGINT << {s})" for t, s in (("f5 < 0", 31), ("f9 > 0", 30), ("f10 > 0", 29), ("f11 > 0", 28), ("f12 > 5000", 27)))
    return f"(({prefix}) + (({morton}) >> 1))"


PROJECTION = _projection()
BOX = ", ".join([f"min(f{i})::BIGINT AS lo{i}" for i in range(14)] + [f"max(f{i})::BIGINT AS hi{i}" for i in range(14)] + ["count(*) AS n"])


def _mean(x: str) -> str:
    s, n = f"sum({x})::BIGINT", "count(*)"
    return f"CASE WHEN {s} >= 0 THEN ({s} + {n} // 2) // {n} ELSE ({s} - {n} // 2) // {n} END"


LISTED = f"listed AS (SELECT *, ((row_number() OVER (ORDER BY {PROJECTION}, ref_id)) * 16 - 1) // (SELECT count(*) FROM refs) AS list_id, row_number() OVER (ORDER BY {PROJECTION}, ref_id) - 1 AS pos FROM refs)"
MEANS = ", ".join(f"{_mean(f'f{i}')} AS c{i}" for i in range(14))
NEAREST = f"""SELECT ref_id, c_list FROM (SELECT l.ref_id, c.list_id AS c_list,
    row_number() OVER (PARTITION BY l.ref_id ORDER BY {_distance('l', 'c', 'f', 'c')}, c.list_id) AS rn FROM listed l CROSS JOIN %s c) WHERE rn = 1"""
KMEANS = f"""WITH {REFS}, {LISTED}, seeds AS (SELECT list_id, {MEANS} FROM listed GROUP BY list_id),
    near1 AS ({NEAREST % 'seeds'}), moved AS (SELECT n.c_list AS list_id, {MEANS} FROM near1 n JOIN listed USING (ref_id) GROUP BY n.c_list),
    centroids AS (SELECT s.list_id, {', '.join(f'coalesce(m.c{i}, s.c{i}) AS c{i}' for i in range(14))} FROM seeds s LEFT JOIN moved m USING (list_id)),
    near2 AS ({NEAREST % 'centroids'})
    SELECT c.list_id, {', '.join(f'c.c{i}::BIGINT AS c{i}' for i in range(14))}, (SELECT count(*) FROM near2 n WHERE n.c_list = c.list_id) AS n FROM centroids c"""

PURITY_FIELDS = {1: [(0, 4), (7, 3), (10, 6), (1, 1), (9, 3), (11, 4), (12, 1), (3, 2)], 2: [(5, 4), (13, 4), (6, 4), (1, 4), (12, 4)]}


def _edges() -> str:
    parts = []
    for t, fields in PURITY_FIELDS.items():
        for place, (f, bits) in enumerate(fields):
            parts.append(
                f"SELECT {t} AS purity_table, {place} AS place, {f} AS feature, b AS bin, CASE WHEN b = {2**bits - 1} THEN 32767 ELSE (SELECT v[least(((b + 1) * len(v)) // {2**bits}, len(v) - 1) + 1] "
                f"FROM (SELECT list(f{f} ORDER BY f{f}) AS v FROM refs)) END AS edge FROM range({2**bits}) t(b)"
            )
    return "edges AS (" + " UNION ALL ".join(parts) + ")"


def _purity_key(t: int) -> str:
    key, shift = [], 0
    for place, (f, bits) in enumerate(PURITY_FIELDS[t]):
        key.append(f"((SELECT count(*) FROM edges e WHERE e.purity_table = {t} AND e.place = {place} AND e.bin < {2**bits - 1} AND refs.f{f} >= e.edge) << {shift})")
        shift += bits
    return " + ".join(key)


def _pure(least: int) -> str:
    return f"SELECT key::BIGINT AS key, least(count(*), 65535)::BIGINT AS cnt, bit_or(CASE WHEN label = 1 THEN 2 ELSE 1 END)::BIGINT AS mask FROM %s GROUP BY key HAVING count(*) >= {least} AND bit_or(CASE WHEN label = 1 THEN 2 ELSE 1 END) < 3"


def _purity(t: int) -> str:
    return f"WITH {REFS}, {_edges()}, k AS (SELECT {_purity_key(t)} AS key, label FROM refs) {_pure(1) % 'k'}"


PURITY_VOTES = f"""WITH {REFS}, {QUERIES}, {_votes()}, {_edges()}, k1 AS (SELECT ref_id, {_purity_key(1)} AS key, label FROM refs), k2 AS (SELECT ref_id, {_purity_key(2)} AS key, label FROM refs),
    p1 AS ({_pure(2) % 'k1'}), p2 AS ({_pure(2) % 'k2'}), s AS (SELECT k1.ref_id, coalesce(p1.mask, p2.mask) AS mask FROM k1 JOIN k2 USING (ref_id) LEFT JOIN p1 ON p1.key = k1.key LEFT JOIN p2 ON p2.key = k2.key)
    SELECT query_id, CASE mask WHEN 1 THEN 0 WHEN 2 THEN 5 ELSE fraud_count END AS fraud_count, mask IS NOT NULL AS shortcut FROM votes JOIN s ON s.ref_id = query_id"""


#: Stand-ins for benchmark runs and requests: columns of orders and events that both engines read.
_THOUSANDTHS = "CAST({} AS DOUBLE) / 1000"
STAND_INS = {
    "score_points": ("orders", [
        "o_orderkey", "50000 + o_custkey % 5000 AS n", "o_orderkey % 50 AS fp", "o_orderkey % 7 AS fn",
        "CASE WHEN o_orderkey % 11 = 0 THEN 30000 ELSE o_orderkey % 3 END AS http", "CAST(16 + o_orderkey * 37 % 250000 AS DOUBLE) / 100 AS p99",
    ]),
    "compared": ("orders", [
        "o_orderkey AS seq", "o_orderpriority AS participant",
        "CAST(16 + o_orderkey * 13 % 997 AS STRING) || CASE o_orderkey % 3 WHEN 0 THEN 'ms' WHEN 1 THEN '' ELSE ' ms' END AS p99",
        "CAST(CASE WHEN o_orderpriority = '1-URGENT' AND o_orderkey % 5 = 0 THEN 5819.38 ELSE 6000 END AS DOUBLE) AS final_score",
        "CASE WHEN o_orderpriority = '2-HIGH' AND o_custkey % 9 = 0 THEN 1 ELSE 0 END AS false_positive_detections", "0 AS false_negative_detections", "0 AS http_errors",
    ]),
    "archive": ("orders", [
        "'r-' || CAST(100000000 + o_orderkey AS STRING) AS file", "CASE o_orderkey % 4 WHEN 0 THEN 'experiment' WHEN 1 THEN NULL ELSE 'candidate' END AS kind",
        "CASE WHEN o_orderkey % 6 = 0 THEN 'native' END AS mode", "CAST(o_orderkey % 90 AS STRING) || 'ms' AS p99",
        "CASE WHEN o_orderkey % 10 = 0 THEN '0.09%' ELSE '0%' END AS failure_rate", "CAST(CASE WHEN o_orderkey % 5 = 0 THEN 5819.38 ELSE 6000 END AS DOUBLE) AS final_score",
        "CASE WHEN o_custkey % 13 = 0 THEN 1 ELSE 0 END AS http", "CASE WHEN o_custkey % 17 = 0 THEN 2 ELSE 0 END AS fp", "o_custkey % 2 AS fn",
    ]),
    "rounds": ("orders", [
        "o_orderkey AS round", "o_orderpriority AS rival", f"{_THOUSANDTHS.format('16 + o_orderkey * 13 % 997')} AS ours",
        f"{_THOUSANDTHS.format('60 + o_custkey * 7 % 991')} AS theirs", "o_orderkey % 3 <> 0 AS clean",
    ]),
    "gate": ("orders", [
        "o_orderkey AS round", f"{_THOUSANDTHS.format('16 + o_orderkey * 13 % 997')} AS ours", f"{_THOUSANDTHS.format('60 + o_custkey * 7 % 991')} AS rival_a",
        f"{_THOUSANDTHS.format('90 + o_custkey * 11 % 983')} AS rival_b", "o_orderkey % 3 <> 0 AS clean",
    ]),
    "http": ("events", [
        "event_id", "CASE WHEN event_id % 3 = 0 THEN 'GET' ELSE 'POST' END AS method", "CASE event_id % 5 WHEN 0 THEN '/ready' WHEN 1 THEN '/x' ELSE '/fraud-score' END AS path",
        "CASE event_id % 4 WHEN 0 THEN 'Host: a' WHEN 1 THEN 'Content-Length: ' || CAST(user_id AS STRING) WHEN 2 THEN 'content-length:' || CAST(event_id AS STRING) ELSE 'Content-Length: z' END AS header",
    ]),
}


def _stand_in(name: str) -> str:
    source, columns = STAND_INS[name]
    return f"(SELECT {', '.join(columns)} FROM {source})"


MARKERS = ("idiot", "worthless", "License", "@", "| ")



def _summary_table() -> str:
    names = ("participant", "runs", "min", "median", "max", "latest", "clean")
    ms = lambda c: f"regexp_replace(printf('%.3f', {c}), '[.]?0+$', '') || 'ms'"
    cells = ["participant", "count(*)::VARCHAR", ms("min(ms)"), ms("median(ms)"), ms("max(ms)"), ms("arg_max(ms, seq)"), "bool_and(final_score = 6000 AND false_positive_detections = 0 AND false_negative_detections = 0 AND http_errors = 0)::VARCHAR"]
    rows = ", ".join(f"{c} AS c{i}" for i, c in enumerate(cells))
    header = ", ".join(f"'{n}'" for n in names)
    widths = ", ".join(f"max(length(c{i})) AS w{i}" for i in range(len(names)))
    line = " || '  ' || ".join(f"rpad(c{i}, w{i}::INTEGER, ' ')" for i in range(len(names)))
    return f"""WITH p AS (SELECT *, regexp_replace(lower(trim(p99)), '\\s*ms$', '')::DOUBLE AS ms FROM {_stand_in('compared')}), t AS (SELECT {rows} FROM p GROUP BY participant),
        r AS (SELECT row_number() OVER (ORDER BY c0) AS place, * FROM t UNION ALL SELECT 0, {header}), w AS (SELECT {widths} FROM r)
        SELECT place::BIGINT AS place, rtrim({line}) AS line FROM r CROSS JOIN w"""


SUMMARY_TABLE = _summary_table()

SQL = {
    "knn_vote": KNN,
    "knn_certified": KNN,
    "knn_ivf": KNN,
    "knn_ivf_all_lists": KNN,
    "knn_kmeans_all_lists": KNN,
    "stream_votes": KNN,
    "stored_tree": KNN,
    "stored_lists": KNN,
    "stored_kmeans": KNN,
    "stored_flat": KNN,
    "references_json": f"WITH {REFS} SELECT row_number() OVER (ORDER BY ref_id) - 1 AS ref_id, * EXCLUDE (ref_id) FROM refs",
    "golden_check": f"""{TX_SCORES.removesuffix(DECISIONS)}, j AS (SELECT *, query_id % 6 AS expected FROM votes)
        SELECT count(*) AS total, count(*) FILTER (expected < 3 AND fraud_count >= 3) AS false_positives, count(*) FILTER (expected >= 3 AND fraud_count < 3) AS false_negatives,
        count(*) FILTER (expected <> fraud_count) AS mismatches, 0::BIGINT AS vectorize_errors, """ + ", ".join(f"count(*) FILTER (fraud_count = {i}) AS bucket_{i}" for i in range(6)) + " FROM j",
    "tx_features": f"WITH {TX} SELECT event_id, {COLUMNS}, label, valid FROM tx",
    "tx_scores": TX_SCORES,
    "tx_scores_nested_loop": TX_SCORES,
    "decision_json": f"""WITH {REFS}, {QUERIES}, {_votes()} SELECT query_id, '{{"approved":' || (fraud_count < 3)::VARCHAR || ',"fraud_score":' || (fraud_count / 5.0::DOUBLE)::VARCHAR || '}}' AS response FROM votes""",
    "replay_histogram": f"WITH {REFS}, {QUERIES}, {_votes()} SELECT (SELECT count(*) FROM refs WHERE label = 0) AS label_0, (SELECT count(*) FROM refs WHERE label = 1) AS label_1, " + ", ".join(f"count(*) FILTER (fraud_count = {i}) AS fraud_{i}" for i in range(6)) + " FROM votes",
    "replay_of_first": f"""WITH {REFS}, queries AS (SELECT ref_id AS query_id, * EXCLUDE (ref_id, label) FROM refs WHERE ref_id IN (SELECT ref_id FROM refs ORDER BY ref_id LIMIT 100)), {_votes()}
        SELECT (SELECT count(*) FROM refs WHERE label = 0) AS label_0, (SELECT count(*) FROM refs WHERE label = 1) AS label_1, """ + ", ".join(f"count(*) FILTER (fraud_count = {i}) AS fraud_{i}" for i in range(6)) + " FROM votes",
    "tx_features_loose": f"WITH {TX} SELECT event_id, {COLUMNS}, label, valid FROM tx",
    "summary_table": SUMMARY_TABLE,
    "confusion": f"""WITH {REFS}, {QUERIES}, {_votes()}, j AS (SELECT *, query_id % 6 AS expected, query_id % 50 <> 0 AS valid FROM votes)
        SELECT count(*) AS total, count(*) FILTER (valid AND expected < 3 AND fraud_count >= 3) AS false_positives, count(*) FILTER (valid AND expected >= 3 AND fraud_count < 3) AS false_negatives,
        count(*) FILTER (valid AND expected <> fraud_count) AS mismatches, count(*) FILTER (NOT valid) AS vectorize_errors, """ + ", ".join(f"count(*) FILTER (valid AND fraud_count = {i}) AS bucket_{i}" for i in range(6)) + " FROM j",
    "mismatch_sample": f"WITH {REFS}, {QUERIES}, {_votes()} SELECT query_id, fraud_count, query_id % 6 AS expected FROM votes WHERE query_id % 50 <> 0 AND query_id % 6 <> fraud_count ORDER BY query_id LIMIT 40",
    "vector_keys": f"WITH {REFS} SELECT ref_id, {PART}::BIGINT AS part_id, ({PROFILE})::BIGINT AS profile, {PROJECTION}::BIGINT AS projection FROM refs",
    "partition_summary": f"WITH {REFS} SELECT {PART}::BIGINT AS part_id, {BOX} FROM refs GROUP BY 1",
    "list_summary": f"WITH {REFS}, {LISTED} SELECT list_id::BIGINT AS list_id, {', '.join(f'({_mean(f'f{i}')})::BIGINT AS c{i}' for i in range(14))}, {BOX} FROM listed GROUP BY list_id",
    "kmeans_lists": KMEANS,
    "profile_buckets": f"WITH {REFS} SELECT ({PROFILE})::BIGINT AS key, least(count(*), 65535)::BIGINT AS cnt, bit_or(CASE WHEN label = 1 THEN 2 ELSE 1 END)::BIGINT AS mask FROM refs GROUP BY 1",
    "quantile_edges": f"WITH {REFS}, {_edges()} SELECT purity_table::INTEGER AS purity_table, place::INTEGER AS place, feature::INTEGER AS feature, bin::INTEGER AS bin, edge::BIGINT AS edge FROM edges",
    "purity_buckets_1": _purity(1),
    "purity_buckets_2": _purity(2),
    "shortcut_votes": f"""WITH {REFS}, {QUERIES}, {_votes()}, k AS (SELECT ref_id, {PROFILE} AS key, label FROM refs), p AS (SELECT key, count(*) AS cnt, bit_or(CASE WHEN label = 1 THEN 2 ELSE 1 END) AS mask FROM k GROUP BY key)
        SELECT query_id, CASE WHEN cnt >= 2 AND mask = 1 THEN 0 WHEN cnt >= 2 AND mask = 2 THEN 5 ELSE fraud_count END AS fraud_count, cnt >= 2 AND mask < 3 AS shortcut FROM votes JOIN k ON k.ref_id = query_id JOIN p USING (key)""",
    "purity_votes": PURITY_VOTES,
    "quantisers": f"SELECT vec_id, {_reference('embedding[1]::DOUBLE * 3')} AS reference_value, {_request('embedding[1]::DOUBLE * 3')} AS request_value FROM embeddings",
    "mcc_lookup": "SELECT event_id, CASE event_type WHEN 'click' THEN 1500 WHEN 'error' THEN 8500 WHEN 'purchase' THEN 2000 WHEN 'signup' THEN 4500 WHEN 'view' THEN 3000 ELSE 5000 END AS risk FROM events",
    "marker_scan": "SELECT * FROM (SELECT doc_id, array_to_string([m for m in [" + ", ".join(f"'{m}'" for m in MARKERS) + "] if contains(text, m)], ',') AS found FROM documents) WHERE found <> ''",
    "score_law": f"""WITH s AS (SELECT *, (fp + 3 * fn + 5 * http)::DOUBLE AS e FROM {_stand_in('score_points')}), d AS (SELECT *, CASE WHEN (fp + fn + http) / n > 0.15 THEN -3000.0 ELSE 1000 * log10(1 / greatest(e / n, 0.001)) - 300 * log10(1 + e) END AS detection,
        CASE WHEN p99 > 2000 THEN -3000.0 ELSE least(3000, 1000 * log10(1000 / p99::DOUBLE)) END AS p99_score FROM s)
        SELECT o_orderkey, n, fp, fn, http, e::BIGINT AS weighted_errors, round(detection, 2)::DOUBLE AS detection, round(p99_score, 2)::DOUBLE AS p99_score, round(detection + p99_score, 2)::DOUBLE AS final FROM d""",
    "run_summary": "SELECT o_orderpriority, count(*) AS runs, min(o_totalprice) AS min, median(o_totalprice) AS median, max(o_totalprice) AS max, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS latest, bool_and(o_totalprice > 1000) AS clean FROM orders GROUP BY 1",
    "participant_summary": f"WITH p AS (SELECT *, regexp_replace(lower(trim(p99)), '\\s*ms$', '')::DOUBLE AS ms FROM {_stand_in('compared')}) SELECT participant, count(*) AS runs, min(ms) AS min, median(ms) AS median, max(ms) AS max, arg_max(ms, seq) AS latest, bool_and(final_score = 6000 AND false_positive_detections = 0 AND false_negative_detections = 0 AND http_errors = 0) AS clean FROM p GROUP BY 1",
    "lower_median": "WITH r AS (SELECT o_orderpriority, o_totalprice AS v, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) AS rn, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders) SELECT o_orderpriority, min(v) AS min, max(v) FILTER (rn = (n - 1) // 2 + 1) AS lower_median, max(v) AS max FROM r GROUP BY 1",
    "representative_run": """WITH a AS (SELECT o_orderpriority, o_orderkey, o_custkey % 5 AS score, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_custkey % 5, o_orderkey) AS rn, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders),
        m AS (SELECT o_orderpriority, score FROM a WHERE rn = (n - 1) // 2 + 1), s AS (SELECT a.*, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) AS rm, count(*) OVER (PARTITION BY o_orderpriority) AS k FROM a JOIN m USING (o_orderpriority, score))
        SELECT o_orderpriority, o_orderkey, score, o_totalprice FROM s WHERE rm = (k - 1) // 2 + 1""",
    "archive_rows": f"SELECT file, coalesce(kind, 'candidate') AS report_kind, coalesce(mode, 'docker') AS benchmark_k6_mode, p99, failure_rate, final_score::DOUBLE AS final_score, http AS http_errors, fp AS false_positive_detections, fn AS false_negative_detections FROM {_stand_in('archive')}",
    "clean_candidates": f"SELECT count(*) FILTER (failure_rate = '0%' AND fp = 0 AND fn = 0 AND http = 0) AS clean FROM {_stand_in('archive')}",
    "latest_by_kind": "SELECT max(event_id) AS latest, max(event_id) FILTER (event_type = 'purchase') AS latest_candidate FROM events",
    "paging": "SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) - 1) // 5 AS page FROM orders",
    "head_to_head": f"SELECT rival, count(*) AS rounds, count(*) FILTER (ours < theirs) * 3 >= count(*) * 2 AS wins, count(*) >= 3 AND round(median(theirs) - median(ours), 9) >= 0.03 AS strong, bool_or(clean AND ours <= 0.27) AS stretch FROM {_stand_in('rounds')} GROUP BY 1",
    "promotion_gate": f"SELECT count(*) FILTER (clean) AS clean_rounds, median(ours)::DOUBLE AS median, count(*) FILTER (clean) >= 3 AND median(ours) <= least(median(rival_a), median(rival_b)) AND count(*) FILTER (round(ours - rival_a, 9) > 0.05 AND round(ours - rival_b, 9) > 0.05) < 2 AS promoted FROM {_stand_in('gate')}",
    "http_requests": f"SELECT event_id, method, path, CASE WHEN method = 'GET' AND path LIKE '/ready%' THEN 'ready' WHEN method = 'POST' AND path LIKE '/fraud-score%' THEN 'score' ELSE 'missing' END AS route, coalesce(try_cast(regexp_extract(header, '(?i)^content-length:\\s*([0-9]+)', 1) AS BIGINT), 0) AS content_length FROM {_stand_in('http')}",
}
