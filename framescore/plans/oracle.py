"""DuckDB statements that compute the registered queries independently.

Views ``embeddings events documents ...`` are the given parquet tables.  The
SQL re-derives every stand-in rule (keys, partitions, offsets, byte values,
centroid model, integer image weights) from the raw tables; nothing is shared
with the Spark side but the rules.
"""

import numpy as np

# Centroid model logits per (vec_id, class) from the raw embeddings.
_DENSE_LOGITS = """
  e AS (SELECT vec_id, label, unnest(embedding) AS x,
               unnest(range(len(embedding))) AS i FROM embeddings),
  c AS (SELECT label AS k, i, avg(x::DOUBLE) AS w FROM e GROUP BY label, i),
  s AS (SELECT e.vec_id, c.k, sum(e.x::DOUBLE * c.w) AS s
        FROM e JOIN c ON e.i = c.i GROUP BY e.vec_id, c.k),
  top AS (SELECT vec_id, k AS label,
                 row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, k) AS rn
          FROM s)
"""

_DENSE_LABELS = f"WITH {_DENSE_LOGITS} SELECT vec_id, CAST(label AS INTEGER) AS label FROM top WHERE rn = 1"

# Bytes of every document: (doc_id, i 0-based, u unsigned value, nb total bytes).
_DOC_BYTES = """
  h AS (SELECT doc_id, hex(encode(text)) AS hx, octet_length(encode(text)) AS nb FROM documents),
  b AS (SELECT doc_id, nb, i, ('0x' || substr(hx, 2 * i + 1, 2))::INTEGER AS u
        FROM (SELECT doc_id, hx, nb, unnest(range(nb)) AS i FROM h))
"""

_ICON_PIXELS = ("list_transform(embedding, lambda x: "
                "least(greatest(floor((x::DOUBLE + 1.0) * 128), 0), 255))")

def _lit(a) -> str:
    a = np.asarray(a, dtype=np.float64)
    if a.ndim == 1:
        return "[" + ", ".join(repr(float(v)) for v in a) + "]"
    return "[" + ", ".join(_lit(r) for r in a) + "]"


def _sigmoid(e: str) -> str:
    return f"(1.0 / (1.0 + exp(-({e}))))"


def lstm_sql(m) -> str:
    """The LSTM recurrence as a recursive CTE over time steps, on DOUBLE lists;
    weights are inlined as literals.  Gate order i, f, g, o."""
    h, f, steps, k = m.hidden, m.features, m.steps, m.classes
    gi, gf, go = _sigmoid("z[k+1]"), _sigmoid(f"z[{h}+k+1]"), _sigmoid(f"z[{3 * h}+k+1]")
    c_new = f"{gf} * c[k+1] + {gi} * tanh(z[{2 * h}+k+1])"
    return f"""
WITH RECURSIVE
w AS (SELECT {_lit(m.w_in)}::DOUBLE[][] AS wi, {_lit(m.w_rec)}::DOUBLE[][] AS wr,
             {_lit(m.b)}::DOUBLE[] AS b, {_lit(m.w_out)}::DOUBLE[][] AS wo,
             {_lit(m.b_out)}::DOUBLE[] AS bo),
run(vec_id, t, emb, h, c) AS (
  SELECT vec_id, 0, embedding::DOUBLE[], list_transform(range({h}), lambda k: 0.0::DOUBLE),
         list_transform(range({h}), lambda k: 0.0::DOUBLE)
  FROM embeddings
  UNION ALL
  SELECT vec_id, t + 1, emb,
         list_transform(range({h}), lambda k: {go} * tanh({c_new})),
         list_transform(range({h}), lambda k: {c_new})
  FROM (SELECT r.vec_id, r.t, r.emb, r.h, r.c,
               list_transform(range({4 * h}), lambda j:
                   list_inner_product(w.wi[j+1], r.emb[r.t*{f}+1 : r.t*{f}+{f}])
                   + list_inner_product(w.wr[j+1], r.h) + w.b[j+1]) AS z
        FROM run r, w WHERE r.t < {steps})
),
fin AS (SELECT vec_id,
               list_transform(range({k}), lambda k: list_inner_product(w.wo[k+1], h) + w.bo[k+1]) AS lg
        FROM run, w WHERE t = {steps})
SELECT vec_id, CAST(list_position(lg, list_max(lg)) - 1 AS INTEGER) AS label FROM fin
"""


ORACLE_SQL = {
    "encode_features": """
SELECT vec_id,
       CAST(1700000000000 + vec_id AS VARCHAR) AS send_time,
       CAST(vec_id % 4 AS INTEGER) AS "partition",
       CAST(vec_id // 4 AS BIGINT) AS "offset",
       array_to_string(list_transform(embedding, lambda x: hex(x::FLOAT::BIT::BLOB)), '') AS payload_hex
FROM embeddings
""",
    "decode_features": """
SELECT vec_id, CAST(i AS BIGINT) AS pos, round(x::DOUBLE, 6) AS x
FROM (SELECT vec_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings)
""",
    "first_feature": """
SELECT vec_id, round(embedding[1]::DOUBLE, 6) AS x FROM embeddings
""",
    "passthrough": """
SELECT vec_id, CAST(vec_id % 4 AS INTEGER) AS "partition", CAST(vec_id // 4 AS BIGINT) AS "offset",
       round(embedding[1]::DOUBLE, 6) AS x, 7 AS n_fields, true AS key_ok
FROM embeddings
""",
    "passthrough_timed": """
SELECT vec_id, CAST(vec_id % 4 AS INTEGER) AS "partition", CAST(vec_id // 4 AS BIGINT) AS "offset",
       round(embedding[1]::DOUBLE, 6) AS x, 7 AS n_fields, true AS key_ok
FROM embeddings
""",
    "feature_csv": """
WITH g AS (SELECT vec_id, embedding, CASE vec_id % 50 WHEN 7 THEN 'short_row' WHEN 8 THEN 'bad_number' END AS r
           FROM embeddings)
SELECT vec_id, CAST(i AS BIGINT) AS pos, round(x::DOUBLE, 6) AS x, r AS reject_reason
FROM (SELECT vec_id, r, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM g WHERE r IS NULL)
UNION ALL SELECT vec_id, NULL, NULL, r FROM g WHERE r IS NOT NULL
""",
    "first_byte_signed": """
SELECT doc_id, CASE WHEN u > 127 THEN u - 256 ELSE u END AS b
FROM (SELECT doc_id,
             CASE WHEN octet_length(encode(text)) > 0
                  THEN ('0x' || substr(hex(encode(text)), 1, 2))::INTEGER END AS u
      FROM documents)
""",
    "scaled_bytes": f"""
WITH {_DOC_BYTES}
SELECT h.doc_id, CAST(h.nb AS BIGINT) AS n,
       round(coalesce(sum((u / 225)::FLOAT::DOUBLE), 0), 3) AS sum225,
       round(coalesce(sum((u / 255)::FLOAT::DOUBLE), 0), 3) AS sum255
FROM h LEFT JOIN b ON h.doc_id = b.doc_id
GROUP BY h.doc_id, h.nb
""",
    "event_records": """
SELECT event_id,
       CAST(user_id % 4 AS INTEGER) AS "partition",
       CAST(row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) - 1 AS BIGINT) AS "offset",
       epoch_us(ts) // 1000 AS send_time,
       CASE WHEN u > 127 THEN u - 256 ELSE u END AS first_byte,
       round(value::FLOAT::DOUBLE, 6) AS x,
       4 AS n_fields
FROM (SELECT *, ('0x' || substr(hex(value::FLOAT::BIT::BLOB), 1, 2))::INTEGER AS u FROM events)
""",
    "score_dense": _DENSE_LABELS,
    "score_softmax": f"""
WITH {_DENSE_LOGITS},
  m AS (SELECT vec_id, max(s) AS ms FROM s GROUP BY vec_id),
  p AS (SELECT s.vec_id, s.k, exp(s.s - m.ms) / sum(exp(s.s - m.ms)) OVER (PARTITION BY s.vec_id) AS p
        FROM s JOIN m ON s.vec_id = m.vec_id)
SELECT top.vec_id, CAST(top.label AS INTEGER) AS label, round(p.p, 5) AS prob, true AS fold_agrees
FROM top JOIN p ON top.vec_id = p.vec_id AND top.label = p.k
WHERE top.rn = 1
""",
    "score_csv": f"""
SELECT vec_id, CASE WHEN vec_id % 50 NOT IN (7, 8) THEN label END AS label,
       CASE vec_id % 50 WHEN 7 THEN 'short_row' WHEN 8 THEN 'bad_number' END AS reject_reason
FROM ({_DENSE_LABELS})
""",
    "score_onnx": _DENSE_LABELS,
    "accuracy": f"""
WITH pred AS ({_DENSE_LABELS})
SELECT count(*) AS n,
       CAST(sum(CASE WHEN pred.label = e.label THEN 1 ELSE 0 END) AS BIGINT) AS n_correct,
       sum(CASE WHEN pred.label = e.label THEN 1 ELSE 0 END) / count(*) AS accuracy
FROM pred JOIN embeddings e ON pred.vec_id = e.vec_id
""",
    "score_images": f"""
WITH {_DOC_BYTES},
  frames AS (SELECT doc_id, nb, unnest(range((nb + 783) // 784)) AS frame FROM h),
  w AS (SELECT k, j, ((j * (k + 3)) % 17) - 8 AS w FROM range(10) t1(k), range(784) t2(j)),
  full_px AS (SELECT doc_id, i // 784 AS frame, i % 784 AS j, u FROM b
              WHERE (i // 784 + 1) * 784 <= nb),
  s AS (SELECT p.doc_id, p.frame, w.k, sum((p.u / 225)::FLOAT::DOUBLE * w.w) AS s
        FROM full_px p JOIN w ON p.j = w.j GROUP BY p.doc_id, p.frame, w.k),
  top AS (SELECT doc_id, frame, k,
                 row_number() OVER (PARTITION BY doc_id, frame ORDER BY s DESC, k) AS rn FROM s)
SELECT f.doc_id, CAST(f.frame AS BIGINT) AS frame, CAST(coalesce(t.k, -1) AS INTEGER) AS label,
       coalesce(CAST(t.k AS VARCHAR), 'bad_width') AS value
FROM frames f LEFT JOIN top t ON f.doc_id = t.doc_id AND f.frame = t.frame AND t.rn = 1
""",
    "idx_tables": f"""
SELECT CAST(label AS INTEGER) AS label, count(*) AS n, CAST(sum(ps) AS BIGINT) AS pixel_sum
FROM (SELECT label, list_sum({_ICON_PIXELS}) AS ps FROM embeddings)
GROUP BY label
""",
    "idx_ranges": f"""
WITH {_DOC_BYTES}
SELECT CAST(doc_id % 10 AS INTEGER) AS label, count(*) // 784 AS n, CAST(sum(u) AS BIGINT) AS pixel_sum
FROM b WHERE (i // 784 + 1) * 784 <= nb
GROUP BY label
""",
    "image_accuracy": f"""
WITH px AS (SELECT vec_id, label, unnest({_ICON_PIXELS}) AS u,
                   unnest(range(len(embedding))) AS j FROM embeddings),
  w AS (SELECT k, j, ((j * (k + 3)) % 17) - 8 AS w FROM range(10) t1(k), range(64) t2(j)),
  s AS (SELECT px.vec_id, w.k, sum((px.u / 255)::FLOAT::DOUBLE * w.w) AS s
        FROM px JOIN w ON px.j = w.j GROUP BY px.vec_id, w.k),
  top AS (SELECT vec_id, k, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, k) AS rn FROM s),
  pred AS (SELECT vec_id, k FROM top WHERE rn = 1)
SELECT count(*) AS n,
       CAST(sum(CASE WHEN pred.k = e.label THEN 1 ELSE 0 END) AS BIGINT) AS n_correct,
       sum(CASE WHEN pred.k = e.label THEN 1 ELSE 0 END) / count(*) AS accuracy
FROM pred JOIN embeddings e ON pred.vec_id = e.vec_id
""",
    "trace_fields": f"""
WITH pred AS ({_DENSE_LABELS})
SELECT vec_id, CAST(1700000000000 + vec_id AS VARCHAR) AS send_time, 'stair-return' AS topic,
       CAST(vec_id % 4 AS INTEGER) AS "partition", CAST(vec_id // 4 AS BIGINT) AS "offset",
       label, 9 AS n_fields,
       CAST(1700000000000 + vec_id AS VARCHAR) || ' : ' || CAST(vec_id % 4 AS VARCHAR) || ' : '
         || CAST(vec_id // 4 AS VARCHAR) || ' : ' || CAST(label AS VARCHAR) AS line
FROM pred
""",
    "stream_replay": f"""
WITH pred AS ({_DENSE_LABELS})
SELECT vec_id, CAST(1700000000000 + vec_id AS VARCHAR) AS send_time,
       CAST(vec_id % 4 AS INTEGER) AS "partition", CAST(vec_id // 4 AS BIGINT) AS "offset", label
FROM pred
""",
    "event_stream": """
SELECT epoch_us(ts) // 1000 AS send_time,
       CASE WHEN u > 127 THEN u - 256 ELSE u END AS first_byte,
       4 AS n_fields
FROM (SELECT ts, ('0x' || substr(hex(value::FLOAT::BIT::BLOB), 1, 2))::INTEGER AS u FROM events)
""",
    "stream_rejects": f"""
SELECT vec_id, CASE vec_id % 10 WHEN 0 THEN 'null_key' WHEN 1 THEN 'null_value' WHEN 2 THEN 'short_value'
                    WHEN 3 THEN 'bad_width' ELSE CAST(label AS VARCHAR) END AS outcome
FROM ({_DENSE_LABELS})
""",
    "stream_topic": """
SELECT vec_id, CAST(vec_id % 4 AS INTEGER) AS "partition", CAST(vec_id // 4 AS BIGINT) AS "offset"
FROM embeddings
""",
    "stream_keyvalue": """
SELECT doc_id, CASE WHEN u > 127 THEN u - 256 ELSE u END AS first_byte,
       CASE WHEN text IS NULL THEN 'null_value' WHEN u IS NULL THEN 'short_value' END AS reject_reason,
       CASE WHEN u IS NOT NULL THEN true END AS clock_ok
FROM (SELECT doc_id, text,
             CASE WHEN octet_length(encode(text)) > 0
                  THEN ('0x' || substr(hex(encode(text)), 1, 2))::INTEGER END AS u
      FROM documents)
""",
    "publish_keys": """
SELECT count(*)::BIGINT AS n, count(*)::BIGINT AS n_timed, 4::BIGINT AS n_partitions, true AS even
FROM embeddings
""",
    "stage_times": """
SELECT vec_id, true AS clock_ok, true AS stages_ok, true AS batch_ok FROM embeddings
""",
    "start_offset": """
SELECT CAST(vec_id % 4 AS INTEGER) AS "partition", count(*) AS n
FROM embeddings WHERE vec_id // 4 >= 10 GROUP BY 1
""",
    "log_offsets": """
SELECT vec_id, CAST(vec_id % 4 AS INTEGER) AS "partition", CAST(vec_id // 4 AS BIGINT) AS "offset"
FROM embeddings WHERE vec_id // 4 >= CASE vec_id % 4 WHEN 0 THEN 10 WHEN 2 THEN 40 ELSE 0 END
""",
    "log_return": f"""
SELECT vec_id, label, true AS dense FROM ({_DENSE_LABELS})
""",
    "stream_commits": f"""
WITH t AS (SELECT vec_id % 10 AS k, len(embedding) AS width, label FROM ({_DENSE_LABELS}) JOIN
             (SELECT vec_id, embedding FROM embeddings) USING (vec_id))
SELECT 'record' AS outcome, count(*)::BIGINT AS n FROM t
UNION ALL SELECT 'line', count(*)::BIGINT FROM t WHERE k > 3
UNION ALL SELECT 'label_sum', sum(label)::BIGINT FROM t WHERE k > 3
UNION ALL SELECT CASE k WHEN 0 THEN 'null_key' WHEN 1 THEN 'null_value' WHEN 2 THEN 'short_value' ELSE 'bad_width' END,
                 count(*)::BIGINT FROM t WHERE k <= 3 GROUP BY 1
UNION ALL SELECT 'reject_bytes', sum(CASE k WHEN 0 THEN 4 * width WHEN 1 THEN 0 WHEN 2 THEN 3 ELSE 2 * width END)::BIGINT
          FROM t WHERE k <= 3
""",
    "first_lines": """
SELECT CAST(row_number() OVER (ORDER BY l_orderkey, l_linenumber) - 1 AS BIGINT) AS pos,
       CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber
FROM lineitem QUALIFY pos < 10000
""",
    "zip_accuracy": f"""
WITH p AS (SELECT d.label AS pred, e.label AS truth, row_number() OVER (ORDER BY vec_id) AS i,
             vec_id <= (SELECT max(vec_id) FROM embeddings) - 7 AS paired
           FROM ({_DENSE_LABELS}) d JOIN embeddings e USING (vec_id))
SELECT count(*) FILTER (paired) AS n, count(*) FILTER (paired AND pred = truth) AS n_correct,
       (count(*) FILTER (paired AND pred = truth) / (count(*) FILTER (paired)))::DOUBLE AS accuracy,
       count(*) FILTER (NOT paired) AS only_left, 0::BIGINT AS only_right
FROM p
""",
    "first_n": f"""
WITH pred AS ({_DENSE_LABELS})
SELECT vec_id, CAST(1700000000000 + vec_id AS VARCHAR) AS send_time,
       CAST(vec_id % 4 AS INTEGER) AS "partition", CAST(vec_id // 4 AS BIGINT) AS "offset", label
FROM pred ORDER BY "offset", "partition" LIMIT 100
""",
}


def _with_lstm():
    from framescore.operators.models import LstmSoftmax
    from framescore.plans.catalog import LSTM_PARAMS
    ORACLE_SQL["score_lstm"] = lstm_sql(LstmSoftmax.seeded(**LSTM_PARAMS))
    ORACLE_SQL["stream_lstm"] = ORACLE_SQL["score_lstm"]
    ORACLE_SQL["stream_images"] = (f"SELECT doc_id, frame, value AS outcome "
                                   f"FROM ({ORACLE_SQL['score_images']})")


_with_lstm()
