"""The jobs as registered queries: run twice into one new folder, and the output as it then stands."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from fogline.session import shared_dir
from jobs import request_batches, track_moves
from jobs.common import settings


def _folder(spark: SparkSession, job: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{job}-{uuid.uuid4().hex}"


def job1_track_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _folder(spark, "track-moves")
    for _ in range(2):
        rows = track_moves.run(spark, f"{sf_dir}/events.parquet", out)
    return rows


def job2_request_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _folder(spark, "request-batches")
    for _ in range(2):
        rows = request_batches.run(spark, f"{sf_dir}/conversations.parquet", out)
    return rows


def _split_sql(hexed: str) -> str:
    u = f"(('0x' || {hexed}[1:10])::BIGINT % 10000 * 4576 + ('0x' || {hexed}[11:25])::BIGINT % 10000 * 6976 + ('0x' || {hexed}[26:40])::BIGINT % 10000) % 10000 / 10000.0"
    return f"CASE WHEN {u} < 0.2 THEN 'test' WHEN {u} < 0.3 THEN 'val' ELSE 'train' END"


_m, _r = settings("track_moves"), settings("request_batches")
SQL = {
    "job1_track_moves": f"""
WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS us, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS cell FROM events),
v AS (SELECT *, coalesce(event_id IS NOT NULL AND user_id IS NOT NULL AND us IS NOT NULL AND cell BETWEEN 0 AND {_m["cells"] - 1}, false) AS valid FROM e),
b AS (SELECT *, lag(us) OVER w AS us0, lag(cell) OVER w AS cell0, lag(event_id) OVER w AS id0 FROM v WINDOW w AS (PARTITION BY user_id, valid ORDER BY us, event_id, cell))
SELECT event_id, user_id, us, cell, CASE WHEN valid THEN cell0 END AS from_cell, CASE WHEN valid THEN us - us0 END AS gap_us,
  CASE WHEN NOT valid THEN 'invalid' WHEN us0 IS NULL THEN 'first' WHEN us = us0 AND event_id = id0 THEN 'repeat' WHEN us - us0 > {int(_m["most_gap_hours"] * track_moves.HOUR)} THEN 'break'
    WHEN cell = cell0 THEN 'stay' ELSE 'move' END AS outcome,
  CASE WHEN user_id IS NULL THEN 'none' ELSE {_split_sql("sha1(user_id::VARCHAR)")} END AS split FROM b""",
    "job2_request_batches": f"""
WITH t AS (SELECT * FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND text IS NOT NULL AND role IN ('system', 'user', 'assistant')),
l AS (SELECT *, role || chr(31) || text AS line FROM t),
p AS (SELECT conv_id, turn, role, array_to_string([{", ".join(f"lag(line, {i}) OVER w" for i in range(_r["context"], 0, -1))}, line], chr(30)) AS request,
  CASE WHEN lead(role) OVER w = 'assistant' THEN lead(text) OVER w END AS reply FROM l WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
a AS (SELECT conv_id, turn, sha256(request) AS key, length(request) / 4 AS tokens_in,
  CASE WHEN length(trim(reply, ' ')) >= {_r["least_answer"]} THEN length(reply) / 4 WHEN reply IS NOT NULL THEN 0.0 END AS tokens_out FROM p WHERE role = 'user'),
k AS (SELECT key, count(*) AS n_asked, min(ROW(conv_id, turn)) AS first, max(tokens_in) AS tokens_in, max(CASE WHEN tokens_out > 0 THEN ROW(conv_id, turn, tokens_out) END) AS answer, count(tokens_out) AS tried FROM a GROUP BY key),
s AS (SELECT key, n_asked, first[1] AS conv_id, first[2] AS turn, tokens_in, coalesce(answer[3], 0.0) AS tokens_out,
  CASE WHEN answer IS NOT NULL THEN 'answered' WHEN tried > 0 THEN 'failed' ELSE 'pending' END AS status, {_split_sql("sha1(key)")} AS split FROM k),
c AS (SELECT *, CASE WHEN status <> 'pending' THEN (tokens_in * {_r["price_per_million"][0]} + tokens_out * {_r["price_per_million"][3]}) / 1e6 ELSE 0.0 END AS cost, ('0x' || key[1:8])::BIGINT % {_r["groups"]} AS g FROM s)
SELECT key, n_asked, conv_id, turn, tokens_in::DOUBLE AS tokens_in, tokens_out::DOUBLE AS tokens_out, cost::DOUBLE AS cost, split, status,
  CASE WHEN status <> 'answered' THEN printf('%s-%02d-%05d', split, g, floor(coalesce(sum(tokens_in) OVER (PARTITION BY split, g, status = 'answered' ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / {_r["batch_tokens"]})::BIGINT) END AS batch FROM c""",
}
QUERIES = {f.__name__: f for f in (job1_track_moves, job2_request_batches)}
