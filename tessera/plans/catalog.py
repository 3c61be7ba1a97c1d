"""Every registered query of the chat-data engine with its SQL.

Results are scalars: arrays are joined or counted, so that two engines can be
compared. SQL works on one row a turn, where the engine works on nested rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import config
from tessera.functions import messages as M
from tessera.functions import replies
from tessera.functions.template import CODE_POINTS, MARKERS
from tessera.operators import encode as E
from tessera.operators import events, geometry, history, ordering, packing, stats, transcripts
from tessera.sources import corpora, workspace
from tessera.streaming import streams

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracle: dict[str, str] = {}

SYSTEM = "You are a careful assistant."
SEED = 42


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql is not None:
            _oracle[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracle)


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _nested(spark: SparkSession, sf: str) -> DataFrame:
    return M.nested(_table(spark, sf, "conversations"))


def _long(*names: str) -> list[Column]:
    return [F.col(n).cast("long").alias(n) for n in names]


# One row a turn with its rendered length, its offset and its conversation's facts.
TURNS = """
t AS (
  SELECT conv_id, turn, role, text, 2 * length(role) + 5 + length(text) AS len FROM conversations
), c AS (
  SELECT conv_id, count(*) AS n, sum(len) AS total, max(turn) AS last_turn FROM t GROUP BY conv_id
), e AS (
  SELECT c.conv_id, c.n, c.total, f.role AS first_role, l.role AS last_role, l.text AS last_text, l.len AS last_len
  FROM c JOIN t f ON f.conv_id = c.conv_id AND f.turn = 0 JOIN t l ON l.conv_id = c.conv_id AND l.turn = c.last_turn
), s AS (
  SELECT t.conv_id, t.turn, t.role, t.text, t.len, e.n, e.total, e.first_role, e.last_role,
         coalesce(sum(t.len) OVER (PARTITION BY t.conv_id ORDER BY t.turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
  FROM t JOIN e ON e.conv_id = t.conv_id
), a AS (
  SELECT conv_id, turn, off + 11 AS start_at, off + 11 + length(text) + 12 AS end_at, total, last_role, first_role FROM s WHERE role = 'assistant'
)"""


@query(f"WITH {TURNS} SELECT e.conv_id, e.n AS n_turns, x.chars AS n_chars, x.roles FROM e JOIN (SELECT conv_id, CAST(sum(length(text)) AS BIGINT) AS chars, string_agg(role, ',' ORDER BY turn) AS roles FROM t GROUP BY conv_id) x ON x.conv_id = e.conv_id")
def messages_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return _summary(M.normalize(_nested(spark, sf)))


def _summary(df: DataFrame) -> DataFrame:
    chars = F.aggregate("turns", F.lit(0).cast("long"), lambda n, m: n + F.length(m["content"]))
    roles = F.array_join(F.transform("turns", lambda m: m["role"]), ",")
    return df.where("drop_reason is null").select("conv_id", F.size("turns").cast("long").alias("n_turns"), chars.alias("n_chars"), roles.alias("roles"))


@query(_oracle["messages_normalize"])
def messages_sharegpt(spark: SparkSession, sf: str) -> DataFrame:
    other = lambda r: F.when(r == "user", "human").when(r == "assistant", "gpt").otherwise(r)
    df = _nested(spark, sf).select("conv_id", F.transform("messages", lambda m: F.struct(other(m["role"]).alias("from"), m["content"].alias("value"))).alias("conversations"))
    return _summary(M.normalize(df, "conversations", M.MessageSchema("from", "value", {"human": "user", "gpt": "assistant"})))


@query(_oracle["messages_normalize"])
def messages_json(spark: SparkSession, sf: str) -> DataFrame:
    return _summary(M.normalize(_nested(spark, sf).withColumn("messages", F.to_json("messages"))))


@query("""SELECT DISTINCT conv_id, CASE conv_id % 11 WHEN 0 THEN 'empty' WHEN 1 THEN 'bad_message' WHEN 2 THEN 'bad_message'
  WHEN 3 THEN 'not_a_sequence' WHEN 4 THEN 'not_a_sequence' WHEN 5 THEN 'not_a_sequence' WHEN 6 THEN 'bad_message' ELSE 'kept' END AS reason FROM conversations""")
def messages_invalid(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("conv_id") % 11
    broken = (
        F.when(k == 0, "[]").when(k == 1, '[{"role":"user","content":null}]').when(k == 2, '[{"role":"user","content":7}]')
        .when(k == 3, '{"role":"user","content":"x"}').when(k == 4, '[{"role":').when(k == 5, F.lit(None)).when(k == 6, '["x"]')
        .otherwise(F.to_json("messages"))
    )
    return M.normalize(_nested(spark, sf).withColumn("messages", broken)).select("conv_id", F.coalesce("drop_reason", F.lit("kept")).alias("reason"))


@query("SELECT DISTINCT conv_id, 'missing_column' AS reason FROM conversations")
def messages_missing_column(spark: SparkSession, sf: str) -> DataFrame:
    return M.normalize(_nested(spark, sf), "chats").select("conv_id", F.col("drop_reason").alias("reason"))


@query(f"WITH {TURNS} SELECT conv_id, CAST(n + CASE WHEN first_role <> 'system' THEN 1 ELSE 0 END AS BIGINT) AS n_turns, first_role <> 'system' AS injected FROM e WHERE last_role = 'assistant'")
def system_prompt_injection(spark: SparkSession, sf: str) -> DataFrame:
    df = M.inject_system(M.final_assistant(M.normalize(_nested(spark, sf))), SYSTEM).where("drop_reason is null")
    return df.select("conv_id", F.size("turns").cast("long").alias("n_turns"), (F.size("turns") > F.size("messages")).alias("injected"))


@query(f"WITH {TURNS} SELECT conv_id, last_role = 'assistant' AS kept FROM e")
def final_assistant_filter(spark: SparkSession, sf: str) -> DataFrame:
    return M.final_assistant(M.normalize(_nested(spark, sf))).select("conv_id", F.col("drop_reason").isNull().alias("kept"))


def _tagged(content: Column) -> Column:
    """Reasoning tags by conv_id: both, the opening one only, or none."""
    k = F.col("conv_id") % 3
    return F.when(k == 0, F.concat(F.lit("<think>a plan</think>"), content)).when(k == 1, F.concat(F.lit("<think>a plan "), content)).otherwise(content)


def _with_tags(df: DataFrame) -> DataFrame:
    last = F.element_at("messages", -1)
    again = F.struct(last["role"].alias("role"), F.when(last["role"] == "assistant", _tagged(last["content"])).otherwise(last["content"]).alias("content"))
    return df.withColumn("messages", F.concat(F.slice("messages", F.lit(1), F.size("messages") - 1), F.array(again)))


@query(f"WITH {TURNS} SELECT conv_id, CASE WHEN last_role <> 'assistant' THEN 'last_not_assistant' WHEN conv_id % 3 <> 0 THEN 'missing_reasoning_tags' ELSE 'kept' END AS reason FROM e")
def reasoning_tag_filter(spark: SparkSession, sf: str) -> DataFrame:
    df = M.require_tags(M.final_assistant(M.normalize(_with_tags(_nested(spark, sf)))))
    return df.select("conv_id", F.coalesce("drop_reason", F.lit("kept")).alias("reason"))


@query("SELECT conv_id, CAST(length(r) AS BIGINT) AS n, md5(r) AS digest FROM (SELECT conv_id, string_agg('<' || role || '>' || text || '</' || role || '>', '' ORDER BY turn) AS r FROM conversations GROUP BY conv_id) x")
def render_chat(spark: SparkSession, sf: str) -> DataFrame:
    r = CODE_POINTS.render(F.col("messages"))
    return _nested(spark, sf).select("conv_id", F.length(r).cast("long").alias("n"), F.md5(r).alias("digest"))


@query("SELECT conv_id, CAST(length(r) AS BIGINT) AS n, md5(r) AS digest FROM (SELECT conv_id, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn) || '<|im_start|>assistant' || chr(10) AS r FROM conversations GROUP BY conv_id) x")
def render_generation_prompt(spark: SparkSession, sf: str) -> DataFrame:
    r = MARKERS.render(F.col("messages"), generate=True)
    return _nested(spark, sf).select("conv_id", F.length(r).cast("long").alias("n"), F.md5(r).alias("digest"))


@query(f"WITH {TURNS} SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY start_at) - 1 AS span, CAST(start_at AS BIGINT) AS start_at, CAST(end_at AS BIGINT) AS end_at FROM a WHERE last_role = 'assistant' AND first_role <> 'assistant'")
def span_list(spark: SparkSession, sf: str) -> DataFrame:
    df = E.kept(E.encode(_nested(spark, sf), E.EncodeConfig(1 << 30, require_reasoning_tags=False)))
    return df.select("conv_id", F.posexplode("spans").alias("span", "s")).select("conv_id", F.col("span").cast("long").alias("span"), F.col("s.start").cast("long").alias("start_at"), F.col("s.end").cast("long").alias("end_at"))


def _encoded_sql(limit: int, policy: str, reasons: bool) -> str:
    length = f"least(total, {limit})"
    over = "'overlength'" if policy == "drop" else "NULL"
    return f"""WITH {TURNS}, k AS (
      SELECT e.conv_id, {length} AS length, CASE WHEN e.last_role <> 'assistant' THEN 'last_not_assistant'
        WHEN e.total > {limit} AND {over} IS NOT NULL THEN {over} WHEN e.first_role = 'assistant' THEN 'assistant_first'
        WHEN x.low >= {length} THEN 'prompt_fills_window' END AS reason, least(x.high, {length}) AS prompt
      FROM e LEFT JOIN (SELECT conv_id, min(start_at) AS low, max(start_at) AS high FROM a GROUP BY conv_id) x ON x.conv_id = e.conv_id
    ), m AS (
      SELECT k.conv_id, sum(least(a.end_at, k.length) - a.start_at) AS supervised FROM k JOIN a ON a.conv_id = k.conv_id AND a.start_at < k.length WHERE k.reason IS NULL GROUP BY k.conv_id
    )
    SELECT k.conv_id, {"coalesce(k.reason, 'kept') AS reason," if reasons else ""} CAST(CASE WHEN k.reason IS NULL THEN k.prompt END AS BIGINT) AS prompt_length,
      CAST(CASE WHEN k.reason IS NULL THEN k.length END AS BIGINT) AS unpadded_length, CAST(m.supervised AS BIGINT) AS supervised
    FROM k LEFT JOIN m ON m.conv_id = k.conv_id {"" if reasons else "WHERE k.reason IS NULL"}"""


def _encoded(df: DataFrame, cfg: E.EncodeConfig) -> DataFrame:
    out = E.encode(df, cfg).withColumn("supervised", F.when(F.col("drop_reason").isNull(), E.supervised("spans")))
    return out.select("conv_id", F.coalesce("drop_reason", F.lit("kept")).alias("reason"), *_long("prompt_length", "unpadded_length", "supervised"))


def _plain(limit: int, **more) -> E.EncodeConfig:
    return E.EncodeConfig(limit, require_reasoning_tags=False, **more)


@query(_encoded_sql(4096, "drop", False))
def assistant_spans(spark: SparkSession, sf: str) -> DataFrame:
    return _encoded(_nested(spark, sf), _plain(4096)).where("reason = 'kept'").drop("reason")


@query(_encoded_sql(2048, "drop", True))
def encode_drop(spark: SparkSession, sf: str) -> DataFrame:
    return _encoded(_nested(spark, sf), _plain(2048))


@query(_encoded_sql(1024, "truncate", True))
def encode_truncate(spark: SparkSession, sf: str) -> DataFrame:
    return _encoded(_nested(spark, sf), _plain(1024, overlength_policy="truncate"))


@query(f"""WITH {TURNS}, k AS (
  SELECT conv_id, least(total, 1500) AS length, total - last_len + 11 AS prompt,
    CASE WHEN last_role <> 'assistant' THEN 'last_not_assistant' WHEN total - last_len + 11 >= least(total, 1500) THEN 'prompt_fills_window' END AS reason FROM e)
SELECT conv_id, coalesce(reason, 'kept') AS reason, CAST(CASE WHEN reason IS NULL THEN prompt END AS BIGINT) AS prompt_length,
  CAST(CASE WHEN reason IS NULL THEN length END AS BIGINT) AS unpadded_length, CAST(CASE WHEN reason IS NULL THEN length END AS BIGINT) AS supervised FROM k""")
def encode_full_loss(spark: SparkSession, sf: str) -> DataFrame:
    return _encoded(_nested(spark, sf), _plain(1500, overlength_policy="truncate", assistant_only_loss=False))


@query(f"SELECT reason, count(*) AS n FROM ({_encoded_sql(2048, 'drop', True)}) z GROUP BY reason")
def drop_reason_funnel(spark: SparkSession, sf: str) -> DataFrame:
    return E.funnel(E.encode(_nested(spark, sf), _plain(2048)))


_MASK_SQL = f"""WITH {TURNS}, r AS (
  SELECT conv_id, string_agg('<' || role || '>' || text || '</' || role || '>', '' ORDER BY turn) AS r FROM t GROUP BY conv_id
), k AS (
  SELECT e.conv_id, r.r, least(e.total, 512) AS length FROM e JOIN r ON r.conv_id = e.conv_id
  JOIN (SELECT conv_id, min(start_at) AS low FROM a GROUP BY conv_id) x ON x.conv_id = e.conv_id
  WHERE e.last_role = 'assistant' AND e.first_role <> 'assistant' AND x.low < least(e.total, 512)
), p AS (SELECT k.conv_id, k.r, k.length, g.i AS place FROM k CROSS JOIN (SELECT unnest(generate_series(0, 511)) AS i) g),
m AS (
  SELECT p.conv_id, p.place, CAST(CASE WHEN p.place < p.length THEN unicode(substr(p.r, CAST(p.place + 1 AS BIGINT), 1)) ELSE 0 END AS BIGINT) AS token,
    p.place < p.length AND count(a.conv_id) > 0 AS supervised
  FROM p LEFT JOIN a ON a.conv_id = p.conv_id AND p.place >= a.start_at AND p.place < a.end_at GROUP BY p.conv_id, p.place, p.length, p.r
)"""


def _masked(spark: SparkSession, sf: str) -> DataFrame:
    cfg = _plain(512, overlength_policy="truncate")
    return E.dense(E.encode(_nested(spark, sf), cfg), cfg)


@query(f"{_MASK_SQL} SELECT conv_id, CAST(place AS BIGINT) AS place, token, supervised FROM m")
def loss_mask_tokens(spark: SparkSession, sf: str) -> DataFrame:
    both = F.arrays_zip("input_tokens", "input_mask")
    rows = _masked(spark, sf).select("conv_id", F.posexplode(both).alias("place", "x"))
    return rows.select("conv_id", F.col("place").cast("long").alias("place"), F.col("x.input_tokens").cast("long").alias("token"), F.col("x.input_mask").alias("supervised"))


@query(f"{_MASK_SQL} SELECT conv_id, CAST(coalesce(max(CASE WHEN supervised THEN place END), -1) AS BIGINT) AS last_target, CAST(sum(CASE WHEN supervised AND place > 0 THEN 1 ELSE 0 END) AS BIGINT) AS targets FROM m GROUP BY conv_id")
def pad_mask_positions(spark: SparkSession, sf: str) -> DataFrame:
    return _masked(spark, sf).select("conv_id", geometry.last_target("input_mask").cast("long").alias("last_target"), geometry.supervised_targets("input_mask").cast("long").alias("targets"))


@query(f"{_MASK_SQL} SELECT conv_id, CAST(sum(token) AS BIGINT) AS token_sum FROM m WHERE place > 0 GROUP BY conv_id")
def causal_targets(spark: SparkSession, sf: str) -> DataFrame:
    total = F.aggregate(geometry.next_tokens("input_tokens"), F.lit(0).cast("long"), lambda n, x: n + x)
    return _masked(spark, sf).select("conv_id", total.alias("token_sum"))


@query(f"{_MASK_SQL}, z AS (SELECT conv_id AS window_id, CASE WHEN token > 0 THEN 1 ELSE 0 END AS segment, count(*) AS n FROM m GROUP BY 1, 2) SELECT window_id, CAST(segment AS BIGINT) AS segment, n, CAST(n * (n + 1) / 2 AS BIGINT) AS pairs FROM z")
def attention_pairs(spark: SparkSession, sf: str) -> DataFrame:
    segments = F.transform("input_tokens", lambda x: F.when(x > 0, 1).otherwise(0))
    out = geometry.attention_counts(_masked(spark, sf).select(F.col("conv_id").alias("window_id"), segments.alias("segment_ids")))
    return out.select("window_id", *_long("segment", "n", "pairs"))


@query("SELECT l_returnflag, round(sum(l_extendedprice * (l_linenumber % 2)) / (sum(l_linenumber % 2) + 1e-8), 3) AS mean, CAST(sum(l_linenumber % 2) AS BIGINT) AS weight FROM lineitem GROUP BY l_returnflag")
def masked_mean_loss(spark: SparkSession, sf: str) -> DataFrame:
    df = _table(spark, sf, "lineitem").withColumn("_w", F.col("l_linenumber") % 2)
    return geometry.masked_mean(df, "l_extendedprice", "_w", ["l_returnflag"]).select("l_returnflag", F.round("mean", 3).alias("mean"), F.col("weight").cast("long").alias("weight"))


@query("SELECT conv_id FROM (SELECT DISTINCT conv_id FROM conversations) d ORDER BY conv_id LIMIT 37")
def max_examples(spark: SparkSession, sf: str) -> DataFrame:
    return ordering.first_n(_ids(spark, sf), 37, "conv_id")


def _ids(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "conversations").select("conv_id").distinct()


_DRAWN = f"""d AS (SELECT conv_id, CAST(('0x' || substr(md5('{SEED}:' || conv_id), 1, 8)) AS BIGINT) AS draw FROM (SELECT DISTINCT conv_id FROM conversations) q),
r AS (SELECT conv_id, draw, row_number() OVER (ORDER BY draw, conv_id) - 1 AS place, count(*) OVER () AS total FROM d)"""


@query(f"WITH {_DRAWN} SELECT conv_id, CASE WHEN place < ceil(total * 0.1) THEN 'eval' ELSE 'train' END AS part FROM r")
def train_eval_split(spark: SparkSession, sf: str) -> DataFrame:
    train, held = ordering.split(_ids(spark, sf), 0.1, "conv_id", SEED)
    return train.select("conv_id", F.lit("train").alias("part")).union(held.select("conv_id", F.lit("eval").alias("part")))


@query(f"WITH {_DRAWN} SELECT conv_id FROM r WHERE place < least(ceil(total * 0.1), 5)")
def eval_cap(spark: SparkSession, sf: str) -> DataFrame:
    return ordering.split(_ids(spark, sf), 0.1, "conv_id", SEED, 5)[1]


@query(f"WITH {_DRAWN} SELECT conv_id, place AS position FROM r")
def shuffle_order(spark: SparkSession, sf: str) -> DataFrame:
    return ordering.numbered(ordering.shuffled(_ids(spark, sf), "conv_id", SEED), ["order_key", "conv_id"]).select("conv_id", "position")


@query(f"""WITH d AS (SELECT conv_id, e.epoch, CAST(('0x' || substr(md5('{SEED}:' || e.epoch || ':' || conv_id), 1, 8)) AS BIGINT) AS draw
  FROM (SELECT DISTINCT conv_id FROM conversations) q CROSS JOIN (SELECT 0 AS epoch UNION ALL SELECT 1 UNION ALL SELECT 2) e)
SELECT CAST(epoch AS BIGINT) AS epoch, conv_id, row_number() OVER (ORDER BY epoch, draw, conv_id) - 1 AS position FROM d""")
def epoch_repeat(spark: SparkSession, sf: str) -> DataFrame:
    df = ordering.shuffled(ordering.repeated(_ids(spark, sf), 3), "conv_id", SEED)
    return ordering.numbered(df, ["epoch", "order_key", "conv_id"]).select(F.col("epoch").cast("long").alias("epoch"), "conv_id", "position")


@query("SELECT conv_id, CAST(floor(place / 8) AS BIGINT) AS batch_id FROM (SELECT conv_id, row_number() OVER (ORDER BY conv_id) - 1 AS place, count(*) OVER () AS total FROM (SELECT DISTINCT conv_id FROM conversations) q) r WHERE place < floor(total / 8) * 8")
def batch_drop_remainder(spark: SparkSession, sf: str) -> DataFrame:
    return ordering.batched(_ids(spark, sf), 8, ["conv_id"]).select("conv_id", F.col("batch_id").cast("long").alias("batch_id"))


# Spans of every assistant turn, as a query of its own.
_SPANS_SQL = f"WITH {TURNS} SELECT conv_id, start_at, end_at FROM a"


def _examples(spark: SparkSession, sf: str) -> DataFrame:
    return E.kept(E.encode(_nested(spark, sf), _plain(4096)))


def _plan(spark: SparkSession, sf: str, **more) -> DataFrame:
    return packing.plan(_examples(spark, sf), 8192, id_col="conv_id", order=["conv_id"], **more)


def _placed_sql(pool: int, shards: int = 1, limit: int = 4096, window: int = 8192, order: str = "conv_id") -> str:
    """First-fit packing as a recursion over the examples of each shard that carries the pool as lists."""
    return f"""WITH RECURSIVE k AS ({_encoded_sql(limit, "drop", False)}),
n AS (SELECT conv_id, unpadded_length AS size, row_number() OVER (ORDER BY {order}) - 1 AS p, count(*) OVER () AS total FROM k),
x AS (SELECT conv_id, size, p * {shards} // total AS sh, row_number() OVER (PARTITION BY p * {shards} // total ORDER BY p) AS i FROM n),
st(sh, i, conv_id, size, used, cid, seg, made, home, segment, start_at, gone) AS (
  SELECT DISTINCT CAST(sh AS BIGINT), CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS BIGINT[]), CAST([] AS BIGINT[]), CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM x
  UNION ALL
  SELECT sh, i + 1, conv, l,
    CASE WHEN f > 0 THEN list_transform(used, lambda u, n: CASE WHEN n = f THEN u + l ELSE u END) ELSE list_append(CASE WHEN e > 0 THEN list_filter(used, lambda u, n: n <> e) ELSE used END, l) END,
    CASE WHEN f > 0 THEN cid ELSE list_append(CASE WHEN e > 0 THEN list_filter(cid, lambda u, n: n <> e) ELSE cid END, made) END,
    CASE WHEN f > 0 THEN list_transform(seg, lambda u, n: CASE WHEN n = f THEN u + 1 ELSE u END) ELSE list_append(CASE WHEN e > 0 THEN list_filter(seg, lambda u, n: n <> e) ELSE seg END, CAST(1 AS BIGINT)) END,
    CASE WHEN f > 0 THEN made ELSE made + 1 END,
    CASE WHEN f > 0 THEN cid[f] ELSE made END, CASE WHEN f > 0 THEN seg[f] + 1 ELSE 1 END, CASE WHEN f > 0 THEN used[f] ELSE 0 END,
    CASE WHEN f = 0 AND e > 0 THEN cid[e] END
  FROM (SELECT st.sh, st.i, st.used, st.cid, st.seg, st.made, x.size AS l, x.conv_id AS conv,
      coalesce(list_position(list_transform(st.used, lambda u: u + x.size <= {window}), true), 0) AS f,
      CASE WHEN len(st.used) >= {pool} THEN list_position(st.used, list_max(st.used)) ELSE 0 END AS e
    FROM st JOIN x ON x.sh = st.sh AND x.i = st.i + 1) z
), o AS (
  SELECT sh, gone AS c, i AS a, CAST(0 AS BIGINT) AS b FROM st WHERE gone IS NOT NULL
  UNION ALL SELECT sh, unnest(cid) AS c, i + 1 AS a, unnest(generate_series(1, len(cid))) AS b
  FROM (SELECT *, row_number() OVER (PARTITION BY sh ORDER BY i DESC) AS back FROM st) q WHERE back = 1
), w AS (SELECT sh, c, row_number() OVER (ORDER BY sh, a, b) - 1 AS window_id FROM o),
placed AS (SELECT st.conv_id, w.window_id, st.segment, st.start_at AS "offset", st.size AS length FROM st JOIN w ON w.c = st.home AND w.sh = st.sh)
"""


_PLACED_COLUMNS = 'conv_id, window_id, CAST(segment AS BIGINT) AS segment, CAST("offset" AS BIGINT) AS "offset", CAST(length AS BIGINT) AS length'
_WINDOWS_SQL = f"""{_placed_sql(8)}, r AS (
  SELECT conv_id, string_agg('<' || role || '>' || text || '</' || role || '>', '' ORDER BY turn) AS r FROM conversations GROUP BY conv_id
), g AS (SELECT DISTINCT p.window_id, s.i FROM placed p CROSS JOIN (SELECT unnest(generate_series(0, 8191)) AS i) s
), y AS (SELECT p.*, r.r FROM placed p JOIN r ON r.conv_id = p.conv_id
), z AS (
  SELECT g.window_id, g.i, y.conv_id, y.segment, g.i - y."offset" AS rel, y.r FROM g
  LEFT JOIN y ON y.window_id = g.window_id AND g.i >= y."offset" AND g.i < y."offset" + y.length
), m AS (
  SELECT z.window_id, z.i, max(z.segment) AS segment, max(z.rel) AS rel, max(unicode(substr(z.r, CAST(z.rel + 1 AS BIGINT), 1))) AS token, count(a.conv_id) > 0 AS hit
  FROM z LEFT JOIN ({_SPANS_SQL}) a ON a.conv_id = z.conv_id AND z.rel > 0 AND z.rel >= a.start_at AND z.rel < a.end_at GROUP BY z.window_id, z.i
)
SELECT window_id, CAST(max(segment) AS BIGINT) AS n_segments, md5(string_agg(CAST(coalesce(token, 0) AS VARCHAR), ' ' ORDER BY i)) AS input_tokens,
  md5(string_agg(CASE WHEN hit THEN 'true' ELSE 'false' END, ' ' ORDER BY i)) AS input_mask, md5(string_agg(CAST(coalesce(rel, 0) AS VARCHAR), ' ' ORDER BY i)) AS positions,
  md5(string_agg(CAST(coalesce(segment, 0) AS VARCHAR), ' ' ORDER BY i)) AS segment_ids FROM m GROUP BY window_id"""


@query(f"{_placed_sql(8)} SELECT {_PLACED_COLUMNS} FROM placed")
def pack_plan(spark: SparkSession, sf: str) -> DataFrame:
    return _plan(spark, sf, shards=1).select("conv_id", "window_id", *_long("segment", "offset", "length"))


@query(f"""WITH RECURSIVE o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS place, count(*) OVER () AS n FROM orders),
p(k, o_orderkey, place, n, x) AS (
  SELECT 0, o_orderkey, place, n, place FROM o
  UNION ALL
  SELECT k + 1, o_orderkey, place, n, CASE WHEN CAST(('0x' || substr(md5('{SEED}:' || k || ':' || greatest(x, other)), 1, 8)) AS BIGINT) % 2 = 1 THEN other ELSE x END
  FROM (SELECT *, (CAST(('0x' || substr(md5('{SEED}:' || k), 1, 8)) AS BIGINT) % n - x + n) % n AS other FROM p WHERE k < {ordering.SWAPS}) q
) SELECT o_orderkey, x AS place, place AS back FROM p WHERE k = {ordering.SWAPS}""")
def permuted_positions(spark: SparkSession, sf: str) -> DataFrame:
    """Orders at permuted places, and the places that the inverse takes them back to."""
    orders = workspace.saved(ordering.numbered(_table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"]), "numbered")
    n = orders.count()
    placed = orders.select("o_orderkey", ordering.permuted(F.col("position"), n, SEED).alias("place"))
    return placed.withColumn("back", ordering.permuted(F.col("place"), n, SEED, back=True))


@query(f"{_placed_sql(8)} SELECT {_PLACED_COLUMNS} FROM placed")
def pack_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Ranges of 32 rows side by side give the sequence of one."""
    return _plan(spark, sf, range_rows=32).select("conv_id", "window_id", *_long("segment", "offset", "length"))


@query(f"{_placed_sql(2)} SELECT {_PLACED_COLUMNS} FROM placed")
def pack_pool_eviction(spark: SparkSession, sf: str) -> DataFrame:
    return _plan(spark, sf, open_windows=2, shards=1).select("conv_id", "window_id", *_long("segment", "offset", "length"))


@query(f"{_placed_sql(8, 4)} SELECT {_PLACED_COLUMNS} FROM placed")
def pack_sharded(spark: SparkSession, sf: str) -> DataFrame:
    return _plan(spark, sf, shards=4).select("conv_id", "window_id", *_long("segment", "offset", "length"))


def _windows(spark: SparkSession, sf: str) -> DataFrame:
    return packing.assemble(_plan(spark, sf, shards=1), _examples(spark, sf), 8192, id_col="conv_id")


@query(_WINDOWS_SQL)
def pack_windows(spark: SparkSession, sf: str) -> DataFrame:
    joined = lambda c: F.md5(F.array_join(F.transform(c, lambda x: x.cast("string")), " ")).alias(c)
    fields = ("input_tokens", "input_mask", "positions", "segment_ids")
    return _windows(spark, sf).select("window_id", F.col("n_segments").cast("long").alias("n_segments"), *[joined(c) for c in fields])


@query(f"{_placed_sql(8)} SELECT CAST(count(DISTINCT window_id) AS BIGINT) AS windows, count(*) AS examples, CAST(sum(length) AS BIGINT) AS tokens, round(sum(length) / (count(DISTINCT window_id) * 8192.0), 9) AS fill FROM placed")
def pack_fill(spark: SparkSession, sf: str) -> DataFrame:
    return stats.fill(_plan(spark, sf, shards=1), 8192).withColumn("fill", F.round("fill", 9))


@query(f"{_placed_sql(8)}, b AS (SELECT window_id, CAST(max(segment) AS BIGINT) AS n_segments FROM placed GROUP BY window_id) SELECT window_id, CAST(floor(window_id / 4) AS BIGINT) AS batch_id, n_segments FROM b WHERE window_id < (SELECT floor(count(*) / 4) * 4 FROM b)")
def packed_batches(spark: SparkSession, sf: str) -> DataFrame:
    return packing.batches(_windows(spark, sf), 4).select("window_id", F.col("batch_id").cast("long").alias("batch_id"), F.col("n_segments").cast("long").alias("n_segments"))


# Final assistant texts as sampled replies.
_SAMPLED = f"""x AS (SELECT conv_id, conv_id % 5 * 500 AS step, last_text,
  CASE conv_id % 3 WHEN 0 THEN '<think>a plan</think>' || last_text WHEN 1 THEN '<think>a plan ' || last_text ELSE last_text END AS completion,
  CASE WHEN conv_id % 7 = 0 THEN NULL ELSE length(last_text) END AS generated FROM e WHERE last_role = 'assistant'),
y AS (SELECT *, strpos(completion, '<think>') AS a1, strpos(completion, '</think>') AS a2, coalesce(generated >= 512, false) AS capped FROM x)"""


def _records(spark: SparkSession, sf: str) -> DataFrame:
    df = M.final_assistant(M.normalize(_nested(spark, sf))).where("drop_reason is null")
    last = F.element_at("turns", -1)["content"]
    df = df.select("conv_id", (F.col("conv_id") % 5 * 500).alias("step"), F.col("conv_id").cast("string").alias("prompt"), _tagged(last).alias("completion"), F.when(F.col("conv_id") % 7 != 0, F.length(last)).alias("generated_tokens"))
    return transcripts.records(df, max_new_tokens=512)


@query(f"""WITH {TURNS.strip()}, {_SAMPLED} SELECT CAST(step AS BIGINT) AS step, CAST(conv_id AS VARCHAR) AS prompt, md5(completion) AS completion, CAST(length(completion) AS BIGINT) AS completion_chars,
  CAST(generated AS BIGINT) AS generated_tokens, a1 > 0 AS has_reasoning_start, a2 > 0 AS has_reasoning_end, a1 > 0 AND a2 > a1 AS reasoning_balanced, capped AS hit_token_cap FROM y""")
def transcript_records(spark: SparkSession, sf: str) -> DataFrame:
    df = _records(spark, sf).withColumn("completion", F.md5("completion"))
    return df.withColumns({c: F.col(c).cast("long") for c in ("step", "completion_chars", "generated_tokens")})


@query(_oracle["transcript_records"])
def transcripts_jsonl_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = workspace.folder(spark, "transcripts")
    transcripts.append_jsonl(_records(spark, sf), path)
    df = transcripts.read_jsonl(spark, path).withColumn("completion", F.md5("completion"))
    return df.withColumns({c: F.col(c).cast("long") for c in ("step", "completion_chars", "generated_tokens")})


@query(f"WITH {TURNS.strip()}, {_SAMPLED} SELECT CAST(step AS BIGINT) AS step, CAST(sum(CASE WHEN a1 > 0 AND a2 > a1 THEN 1 ELSE 0 END) AS BIGINT) AS closed, CAST(sum(CASE WHEN capped THEN 1 ELSE 0 END) AS BIGINT) AS capped, count(*) AS total FROM y GROUP BY step")
def transcripts_by_step(spark: SparkSession, sf: str) -> DataFrame:
    return transcripts.by_step(_records(spark, sf)).select(F.col("step").cast("long").alias("step"), "closed", "capped", "total")


@query(f"WITH {TURNS.strip()}, {_SAMPLED} SELECT CAST(step AS BIGINT) AS step, CAST(conv_id AS VARCHAR) AS prompt FROM y WHERE NOT (a1 > 0 AND a2 > a1) AND NOT capped")
def unclosed_traces(spark: SparkSession, sf: str) -> DataFrame:
    return transcripts.unclosed(_records(spark, sf)).select(F.col("step").cast("long").alias("step"), "prompt")


@query(f"WITH {TURNS.strip()}, {_SAMPLED} SELECT CAST(step AS BIGINT) AS step, CAST(conv_id AS VARCHAR) AS prompt, CAST(generated AS BIGINT) AS generated_tokens, a1 > 0 AND a2 > a1 AS reasoning_balanced, capped AS hit_token_cap, md5(completion) AS completion FROM y")
def transcript_table(spark: SparkSession, sf: str) -> DataFrame:
    df = _records(spark, sf).select(*transcripts.LOGGED).withColumn("completion", F.md5("completion"))
    return df.withColumns({c: F.col(c).cast("long") for c in ("step", "generated_tokens")})


@query("SELECT event_id, CAST(event_id % 50 AS BIGINT) AS every, event_id % 50 > 0 AND event_id > 0 AND CASE WHEN event_id % 50 > 0 THEN event_id % (event_id % 50) = 0 ELSE false END AS due FROM events")
def sample_steps(spark: SparkSession, sf: str) -> DataFrame:
    every = F.col("event_id") % 50
    return _table(spark, sf, "events").select("event_id", every.alias("every"), F.coalesce(transcripts.should_sample(F.col("event_id"), every), F.lit(False)).alias("due"))


@query(f"""WITH {TURNS}, h AS (
  SELECT t.conv_id, k.k, e.n - 2 * k.k AS remain, 11 + coalesce(sum(CASE WHEN t.turn >= 2 * k.k THEN t.len END), 0) AS tokens, e.n
  FROM t JOIN e ON e.conv_id = t.conv_id CROSS JOIN (SELECT unnest(generate_series(0, 60)) AS k) k WHERE 2 * k.k <= e.n + 1 GROUP BY t.conv_id, k.k, e.n
), z AS (SELECT conv_id, min(k) AS k FROM h WHERE tokens <= 1500 OR remain <= 1 GROUP BY conv_id)
SELECT h.conv_id, CAST(h.tokens AS BIGINT) AS token_count, CAST(least(2 * h.k, h.n) AS BIGINT) AS removed_turns, CAST(CASE WHEN h.tokens <= 1500 THEN greatest(h.remain, 0) END AS BIGINT) AS n_fitted
FROM h JOIN z ON z.conv_id = h.conv_id AND z.k = h.k""")
def fit_history(spark: SparkSession, sf: str) -> DataFrame:
    df = history.fit_history(_nested(spark, sf), 1500).withColumn("n_fitted", F.when(F.col("fitted").isNotNull(), F.size("fitted")))
    return df.select("conv_id", *_long("token_count", "removed_turns", "n_fitted"))


_MARKED = "'  ' || text || CASE (conv_id + turn) % 3 WHEN 0 THEN '<|im_end|>' WHEN 1 THEN ' <|endoftext|>' ELSE '' END"


@query(f"SELECT conv_id, turn, md5(trim(regexp_replace({_MARKED}, '(<\\|im_end\\|>|<\\|endoftext\\|>)$', ''), ' ' || chr(10) || chr(9))) AS reply FROM conversations")
def clean_reply(spark: SparkSession, sf: str) -> DataFrame:
    k = (F.col("conv_id") + F.col("turn")) % 3
    text = F.concat(F.lit("  "), "text", F.when(k == 0, "<|im_end|>").when(k == 1, " <|endoftext|>").otherwise(""))
    return _table(spark, sf, "conversations").select("conv_id", "turn", F.md5(replies.clean_reply(text)).alias("reply"))


@query("""SELECT conv_id, turn, md5(CASE (conv_id + turn) % 3 WHEN 0 THEN text WHEN 1 THEN '<think>x</think>' || text ELSE text END) AS reply FROM conversations""")
def visible_reply(spark: SparkSession, sf: str) -> DataFrame:
    k = (F.col("conv_id") + F.col("turn")) % 3
    text = F.concat(F.when(k == 0, "<think>\n\n</think>\n\n").when(k == 1, "<think>x</think>").otherwise(""), "text")
    return _table(spark, sf, "conversations").select("conv_id", "turn", F.md5(replies.visible_reply(text)).alias("reply"))


def _lengths(spark: SparkSession, sf: str) -> DataFrame:
    return _nested(spark, sf).select("conv_id", F.length(CODE_POINTS.render(F.col("messages"))).cast("long").alias("length"))


@query(f"WITH {TURNS} SELECT " + ", ".join(f"round(CAST(quantile_cont(total, {p}) AS DOUBLE), 6) AS p{round(p * 100)}" for p in (0.5, 0.75, 0.9, 0.99)) + " FROM e")
def length_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    out = stats.percentiles(_lengths(spark, sf), "length")
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query(f"WITH {TURNS} SELECT CAST(m.max_length AS BIGINT) AS max_length, CAST(sum(CASE WHEN e.total <= m.max_length THEN 1 ELSE 0 END) AS BIGINT) AS kept, round(sum(CASE WHEN e.total <= m.max_length THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE), 9) AS share FROM e CROSS JOIN (SELECT unnest([2048, 4096, 8192, 16384]) AS max_length) m GROUP BY m.max_length")
def retention_curve(spark: SparkSession, sf: str) -> DataFrame:
    return stats.retention(_lengths(spark, sf), "length").withColumn("share", F.round("share", 9))


@query(f"WITH {TURNS} SELECT conv_id % 4 AS domain, count(*) AS before, CAST(sum(CASE WHEN total <= 3000 THEN 1 ELSE 0 END) AS BIGINT) AS after FROM e GROUP BY conv_id % 4")
def domain_mix(spark: SparkSession, sf: str) -> DataFrame:
    df = _lengths(spark, sf).withColumns({"domain": F.col("conv_id") % 4, "_kept": F.col("length") <= 3000})
    return stats.mix(df, "domain", "_kept")


@query(f"""WITH {TURNS.strip()}, d AS (SELECT conv_id, conv_id % 4 AS domain, total, CAST(('0x' || substr(md5('{SEED}:' || conv_id), 1, 8)) AS BIGINT) AS draw FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY draw, conv_id) AS k, count(*) OVER (PARTITION BY domain) AS n FROM d)
SELECT conv_id, domain, CAST(total AS BIGINT) AS length, CAST(n AS DOUBLE) / least(n, 10) AS weight FROM r WHERE k <= 10""")
def stratified_lengths(spark: SparkSession, sf: str) -> DataFrame:
    df = _lengths(spark, sf).withColumn("domain", F.col("conv_id") % 4)
    return ordering.stratified(df, "domain", 10, "conv_id", SEED).select("conv_id", "domain", "length", "weight")


@query("""WITH m AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id END AS step, CASE event_id % 5 WHEN 0 THEN '/train/' WHEN 1 THEN 'eval/' WHEN 2 THEN 'jax/' WHEN 3 THEN '//eval/' ELSE 'pretrain/' END || event_type AS event FROM events)
SELECT event_id, event, step FROM m WHERE step IS NOT NULL AND (ltrim(event, '/') LIKE 'train/%' OR ltrim(event, '/') LIKE 'eval/%')""")
def metric_event_filter(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id") % 5
    name = F.concat(F.when(k == 0, "/train/").when(k == 1, "eval/").when(k == 2, "jax/").when(k == 3, "//eval/").otherwise("pretrain/"), "event_type")
    df = _table(spark, sf, "events").select("event_id", name.alias("event"), F.when(F.col("event_id") % 7 != 0, F.col("event_id")).alias("step"))
    return events.stepped_metrics(df)


@query("""WITH m AS (SELECT event_id, event_id % 5 * 10 + 10 AS level, CASE event_id % 3 WHEN 0 THEN '/lib/orbax/io.py' WHEN 1 THEN '/lib/sft/orbax_utils.py' ELSE '/lib/app.py' END AS pathname FROM events),
d AS (SELECT event_id, pathname, CASE WHEN level = 20 AND pathname LIKE '%/orbax/%' THEN 10 ELSE level END AS level FROM m)
SELECT event_id, pathname, CAST(level AS BIGINT) AS level, CASE level WHEN 10 THEN 'DEBUG' WHEN 20 THEN 'INFO' WHEN 30 THEN 'WARNING' WHEN 40 THEN 'ERROR' ELSE 'CRITICAL' END AS level_name FROM d WHERE level >= 20""")
def log_demotion(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id") % 3
    path = F.when(k == 0, "/lib/orbax/io.py").when(k == 1, "/lib/sft/orbax_utils.py").otherwise("/lib/app.py")
    df = _table(spark, sf, "events").select("event_id", path.alias("pathname"), (F.col("event_id") % 5 * 10 + 10).cast("int").alias("level"))
    return events.demoted(df).where("level >= 20").select("event_id", "pathname", F.col("level").cast("long").alias("level"), "level_name")


_PATHS = ("attn.q_proj.w", "attn.o_proj.w", "mlp.up_proj.kernel", "attn.k_norm.w", "input_layernorm.w")
_KEYS = ("self_attn.q_proj", "self_attn.o_proj", "mlp.up_proj", "self_attn.k_norm", "input_layernorm")


def _parameters(spark: SparkSession, sf: str, layer: str = "p_partkey % 28") -> DataFrame:
    k = F.col("p_partkey") % 5
    name = F.lit(None).cast("string")
    for i, p in enumerate(_PATHS):
        name = F.when(k == i, p).otherwise(name)
    path = F.concat(F.lit("layers."), F.expr(layer).cast("string"), F.lit("."), name)
    return _table(spark, sf, "part").select("p_partkey", events.parameter_key(path, F.lit(3)).alias("key"))


def _keyed_sql(layer: str = "p_partkey % 28") -> str:
    return f"SELECT p_partkey, 'model.layers.' || ({layer}) || '.' || CASE p_partkey % 5 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(_KEYS)) + " END || '.weight' AS key FROM part"


@query(_keyed_sql())
def param_key_map(spark: SparkSession, sf: str) -> DataFrame:
    return _parameters(spark, sf)


@query(f"WITH b AS (SELECT DISTINCT key FROM ({_keyed_sql()}) k), x AS (SELECT DISTINCT key FROM ({_keyed_sql('p_size')}) k) SELECT 'missing' AS side, key FROM b WHERE key NOT IN (SELECT key FROM x) UNION ALL SELECT 'extra' AS side, key FROM x WHERE key NOT IN (SELECT key FROM b)")
def param_key_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Layers numbered by key against layers numbered by size, over all parts."""
    return events.key_difference(_parameters(spark, sf), _parameters(spark, sf, "p_size"))


@query(f"SELECT key, count(*) AS n FROM ({_keyed_sql()}) k GROUP BY key HAVING count(*) > 1")
def param_key_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return events.duplicate_keys(_parameters(spark, sf))


@query("SELECT o_orderkey AS step, round(CASE WHEN o_orderkey < 750 THEN 0.0002 * o_orderkey / 750 ELSE 0.0002 * (0.1 + 0.9 * (1 + cos(3.141592653589793 * least((o_orderkey - 750) / 14250.0, 1.0))) / 2) END, 12) AS rate FROM orders")
def lr_schedule(spark: SparkSession, sf: str) -> DataFrame:
    """The rate at the steps that orders are numbered by, those behind the schedule's end included."""
    rate = events.learning_rate(F.col("o_orderkey"), 15_000, 2e-4, warmup_ratio=0.05)
    return _table(spark, sf, "orders").select(F.col("o_orderkey").alias("step"), F.round(rate, 12).alias("rate"))


@query(f"WITH {TURNS}, r AS (SELECT total, row_number() OVER (ORDER BY total) AS k, count(*) OVER () AS n FROM e) SELECT 'p' || p AS point, true AS within FROM (SELECT unnest([50, 75, 90, 99]) AS p) q WHERE EXISTS (SELECT 1 FROM r)")
def sketched_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Percentiles from kept sketches of shards, each within the stated error of its exact rank."""
    lengths = _lengths(spark, sf).withColumn("shard", F.col("conv_id") % 8)
    asked = stats.sketched_percentiles(stats.sketches(lengths, "length", "shard"))
    points = F.explode(F.array(*[F.struct(F.lit(c).alias("point"), F.col(c).alias("x")) for c in asked.columns])).alias("a")
    # Four answers meet all lengths: counts at and under each of them.
    met = lengths.join(F.broadcast(asked.select(points).select("a.point", "a.x")))
    ranks = met.groupBy("point").agg(F.count_if(F.col("length") < F.col("x")).alias("below"), F.count_if(F.col("length") <= F.col("x")).alias("upto"), F.count(F.lit(1)).alias("n"))
    share, error = F.substr("point", F.lit(2)).cast("int") / 100, stats.SKETCH_ERROR
    return ranks.select("point", ((F.col("below") / F.col("n") <= share + error) & (F.col("upto") / F.col("n") >= share - error)).alias("within"))


@query("SELECT CAST(greatest(1, floor(floor(count(*) / 8) * 3 / 4)) AS BIGINT) AS steps FROM (SELECT DISTINCT conv_id FROM conversations) q")
def max_steps(spark: SparkSession, sf: str) -> DataFrame:
    recipe = {"dataset": {"batch_size": 8, "num_train_epochs": 3}, "training": {"gradient_accumulation_steps": 4}}
    return spark.createDataFrame([(config.max_steps(recipe, _ids(spark, sf).count()),)], "steps long")


@query("SELECT p_partkey, CAST(pow(2, ceil(log2(p_size))) AS BIGINT) AS prompt_length FROM part")
def prompt_length_pow2(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "part").select("p_partkey", events.power_of_two(F.col("p_size")).alias("prompt_length"))


@query("WITH n AS (SELECT CASE n_nationkey % 3 WHEN 0 THEN CAST(n_nationkey * 500 AS VARCHAR) WHEN 1 THEN n_name ELSE n_nationkey || '-tmp' END AS name FROM nation) SELECT DISTINCT CAST(name AS BIGINT) AS step FROM n WHERE regexp_full_match(name, '[0-9]+')")
def checkpoint_steps(spark: SparkSession, sf: str) -> DataFrame:
    """Folders named by the nations, of which some are steps; there are as many as nations."""
    k = F.col("n_nationkey")
    name = F.when(k % 3 == 0, (k * 500).cast("string")).when(k % 3 == 1, F.col("n_name")).otherwise(F.concat(k.cast("string"), F.lit("-tmp")))
    root = workspace.folder(spark, "steps")
    _table(spark, sf, "nation").select(name.alias("name"), F.lit(1).alias("x")).write.partitionBy("name").parquet(root)
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for status in (at := fs(root)).getFileSystem(conf := spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at):
        folder = status.getPath()
        folder.getFileSystem(conf).rename(folder, fs(at, folder.getName().removeprefix("name=")))
    return spark.createDataFrame([(s,) for s in corpora.checkpoint_steps(spark, root)], "step long")


@query(_encoded_sql(2048, "drop", False))
def stream_encode(spark: SparkSession, sf: str) -> DataFrame:
    """The same rows by a stream over files of nested conversations."""
    source, out, state = (workspace.folder(spark, n) for n in ("stream-in", "stream-out", "stream-state"))
    _nested(spark, sf).write.parquet(source)
    rows = spark.readStream.schema(_nested(spark, sf).schema).parquet(source)
    encoded = streams.encode_stream(rows, _plain(2048)).withColumn("supervised", E.supervised("spans"))
    encoded = encoded.select("conv_id", *_long("prompt_length", "unpadded_length", "supervised"))
    encoded.writeStream.option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(encoded.schema).parquet(out)


@query(f"{_MASK_SQL}, l AS (SELECT conv_id, coalesce(max(CASE WHEN supervised THEN place END), -1) AS last FROM m GROUP BY conv_id) SELECT conv_id, CAST(last AS BIGINT) AS last_target, CAST(sum(greatest(least(g.i, last), 0)) AS BIGINT) AS position_sum, CAST(sum(least(g.i, last) + 1) AS BIGINT) AS visible FROM l CROSS JOIN (SELECT unnest(generate_series(0, 511)) AS i) g GROUP BY conv_id, last")
def unpacked_inputs(spark: SparkSession, sf: str) -> DataFrame:
    """Positions and visible (query, key) pairs of rows of one example each."""
    rows = geometry.model_inputs(_masked(spark, sf))
    places = F.sequence(F.lit(0), F.lit(511))
    seen = F.aggregate(places, F.lit(0).cast("long"), lambda n, q: n + F.size(F.filter(F.sequence(F.lit(0), F.greatest(F.col("last_target"), F.lit(0))), lambda k: geometry.attends_unpacked(F.col("last_target"), q, k))))
    total = F.aggregate("positions", F.lit(0).cast("long"), lambda n, p: n + p)
    return rows.select("conv_id", F.col("last_target").cast("long").alias("last_target"), total.alias("position_sum"), seen.alias("visible"))


@query(f"WITH {TURNS} SELECT e.conv_id, CAST(total + 11 + {2 * len('system') + 5 + len(SYSTEM)} AS BIGINT) AS tokens, CASE WHEN length(f.text) = 0 THEN 'empty_prompt' WHEN total + 11 + {2 * len('system') + 5 + len(SYSTEM)} > 2000 THEN 'prompt_too_long' END AS reason FROM e JOIN t f ON f.conv_id = e.conv_id AND f.turn = 0")
def prompt_rejection(spark: SparkSession, sf: str) -> DataFrame:
    tokens = history.prompt_tokens(F.col("messages"), system=SYSTEM)
    prompt = F.get("messages", F.lit(0))["content"]
    return _nested(spark, sf).select("conv_id", tokens.cast("long").alias("tokens"), history.prompt_rejection(prompt, tokens, 2000).alias("reason"))
