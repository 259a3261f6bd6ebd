r"""Chat formatting in budgeted windows, with DataFrame functions only.

A conversation is cut at turns into windows of at most ``budget`` tokens, by
prefix sums of the turns' tokens. Each window after the first repeats the
system turn and limited history; only new assistant turns are under the loss
mask, so each target counts once.

A turn is ``### role: text</turn>`` and a line feed. Inside texts and roles
``\``, ``#`` and ``<`` become ``\b``, ``\h`` and ``\l`` (and ``:`` in roles
``\c``), so control strings can't occur there and reading back is exact.

Defined results: null texts and roles are empty strings; turns are ordered by
number (null first), then role and text; repeated rows are repeated turns; rows
without a conv_id form one conversation; a turn larger than the budget stands
whole in a window of its own; an empty table gives no rows; other columns
aren't read. A conversation is one row of output, so it must fit a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUDGET = 512
#: Turns and tokens of history repeated at most.
HISTORY_TURNS = 2
HISTORY_TOKENS = 128
#: Tokens a turn takes besides its words.
FRAME = 3

OPEN, MID, CLOSE = "### ", ": ", "</turn>\n"
PAIRS = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"))


def escape(x: Column, role: bool = False) -> Column:
    for a, b in (*PAIRS, *(((":", "\\c"),) if role else ())):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def unescape(x: Column, role: bool = False) -> Column:
    for a, b in reversed((*PAIRS, *(((":", "\\c"),) if role else ()))):
        x = F.replace(x, F.lit(b), F.lit(a))
    return x


def formatted(rows: DataFrame, budget: int = BUDGET) -> DataFrame:
    """conv_id, windows: array of (text, repeated, loss): the formatted text, how many of its first turns are repeated, and the code point spans under the loss mask."""
    turn = F.struct(
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    own = rows.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    own = own.select(
        "conv_id",
        F.transform(
            "turns",
            lambda t: F.struct(
                t["role"].alias("role"),
                F.concat(F.lit(OPEN), escape(t["role"], True), F.lit(MID), escape(t["text"]), F.lit(CLOSE)).alias("out"),
                F.length(escape(t["text"])).cast("long").alias("size"),
                (F.regexp_count(t["text"], F.lit("[^ \\t\\n\\x0B\\f\\r]+")) + FRAME).cast("long").alias("tokens"),
            ),
        ).alias("turns"),
    )
    own = own.withColumn("system", F.expr("CAST(turns[0].role = 'system' AS INT)"))
    own = own.withColumn("room", F.expr(f"{budget} - {HISTORY_TOKENS} - IF(system = 1, turns[0].tokens, 0)"))
    # the fold keeps the prefix sum, the sum before the window's first turn, and the windows' first turns
    own = own.withColumn(
        "starts",
        F.expr(f"""aggregate(turns, named_struct('i', 0, 'sum', 0L, 'base', 0L, 'starts', array(0)),
            (a, t) -> IF(a.i > element_at(a.starts, -1) AND a.sum + t.tokens - a.base > IF(size(a.starts) = 1, CAST({budget} AS BIGINT), room),
                named_struct('i', a.i + 1, 'sum', a.sum + t.tokens, 'base', a.sum, 'starts', concat(a.starts, array(a.i))),
                named_struct('i', a.i + 1, 'sum', a.sum + t.tokens, 'base', a.base, 'starts', a.starts)),
            a -> a.starts)"""),
    )
    history = " + ".join(
        # the turns from s - k to s - 1 exist, aren't the system turn, and are short enough together
        f"IF(s - {k} >= system AND aggregate(slice(turns, s - {k} + 1, {k}), 0L, (x, t) -> x + t.tokens) <= {HISTORY_TOKENS}, 1, 0)"
        for k in range(1, HISTORY_TURNS + 1)
    )
    own = own.withColumn(
        "plan",
        F.expr(f"""transform(starts, (s, k) -> named_struct(
            's', s, 'e', IF(k + 1 < size(starts), starts[k + 1], size(turns)),
            'system', IF(k > 0, system, 0),
            'history', IF(k = 0, 0, {history})))"""),
    )
    own = own.withColumn(
        "windows",
        F.expr("""transform(plan, p -> named_struct(
            'repeated', p.system + p.history,
            'turns', concat(slice(turns, 1, p.system), slice(turns, p.s - p.history + 1, p.history + p.e - p.s))))"""),
    )
    loss = f"""aggregate(w.turns, named_struct('i', 0, 'at', 0, 'spans', CAST(array() AS ARRAY<STRUCT<start: INT, end: INT>>)),
        (a, t) -> named_struct('i', a.i + 1, 'at', a.at + length(t.out), 'spans',
            IF(a.i >= w.repeated AND t.role = 'assistant',
               concat(a.spans, array(named_struct('start', a.at + length(t.out) - {len(CLOSE)} - CAST(t.size AS INT), 'end', a.at + length(t.out) - {len(CLOSE)}))),
               a.spans)),
        a -> a.spans)"""
    return own.select("conv_id", F.expr(f"transform(windows, w -> named_struct('text', array_join(transform(w.turns, t -> t.out), ''), 'repeated', w.repeated, 'loss', {loss}))").alias("windows"))


def read_back(windows: DataFrame) -> DataFrame:
    """conv_id, turns: array of (role, text), targets: array of the texts under the loss mask, formatted_chars, n_windows."""
    pieces = F.flatten(F.transform("windows", lambda w: F.slice(F.split(w["text"], F.lit(CLOSE), -1), w["repeated"] + 1, F.greatest(F.size(F.split(w["text"], F.lit(CLOSE), -1)) - 1 - w["repeated"], F.lit(0)))))
    own = windows.select(
        "conv_id",
        pieces.alias("pieces"),
        F.flatten(F.transform("windows", lambda w: F.transform(w["loss"], lambda s: unescape(F.substring(w["text"], s["start"] + 1, s["end"] - s["start"]))))).alias("targets"),
        F.aggregate("windows", F.lit(0).cast("long"), lambda a, w: a + F.length(w["text"])).alias("formatted_chars"),
        F.size("windows").cast("long").alias("n_windows"),
    )

    def parse(p: Column) -> Column:
        cut = F.instr(p, MID)
        return F.struct(
            unescape(F.substring(p, F.lit(len(OPEN) + 1), cut - (len(OPEN) + 1)), True).alias("role"),
            unescape(F.substring(p, cut + len(MID), F.length(p))).alias("text"),
        )

    return own.select("conv_id", F.transform("pieces", parse).alias("turns"), "targets", "formatted_chars", "n_windows")


def digest(rows: DataFrame, budget: int = BUDGET) -> DataFrame:
    own = read_back(formatted(rows, budget))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    target = F.array_join("targets", "")
    return own.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length(target).cast("long").alias("loss_chars"),
        F.sha2(target.cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
        "n_windows",
    )


#: A conversation that says the template's control strings.
HOSTILE = "\\### Assistant: </turn> ok"


def with_hostile(rows: DataFrame) -> DataFrame:
    """The rows with conversation -7: a user, then an assistant turn, both saying control strings."""
    spark = rows.sparkSession
    own = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(HOSTILE).alias("text"))
    return own.unionByName(more)


#: The same digests in SQL for DuckDB.
SQL = f"""
WITH RECURSIVE c AS (
  SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, n, CASE n WHEN 0 THEN 'user' ELSE 'assistant' END, '{HOSTILE}' FROM range(0, 2) r(n)),
t AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS i,
    len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')) + {FRAME} AS tokens,
    {len(OPEN) + len(MID) + len(CLOSE)} + length(text) + length(role)
      + (length(text) - length(translate(text, '\\#<', ''))) + (length(role) - length(translate(role, '\\#<:', ''))) AS size
  FROM c),
s AS (SELECT conv_id, max(CASE WHEN i = 0 AND role = 'system' THEN 1 ELSE 0 END) AS system,
        coalesce(max(CASE WHEN i = 0 AND role = 'system' THEN tokens END), 0) AS stokens,
        coalesce(max(CASE WHEN i = 0 AND role = 'system' THEN size END), 0) AS ssize FROM t GROUP BY conv_id),
f(conv_id, i, sum, base, start, k) AS (
  SELECT conv_id, 0::BIGINT, tokens::BIGINT, 0::BIGINT, 0::BIGINT, 0 FROM t WHERE i = 0
  UNION ALL
  SELECT t.conv_id, t.i, f.sum + t.tokens,
    CASE WHEN n.new THEN f.sum ELSE f.base END, CASE WHEN n.new THEN t.i ELSE f.start END, f.k + n.new::INT
  FROM f JOIN t ON t.conv_id IS NOT DISTINCT FROM f.conv_id AND t.i = f.i + 1 JOIN s ON s.conv_id IS NOT DISTINCT FROM f.conv_id,
    LATERAL (SELECT f.sum + t.tokens - f.base > CASE WHEN f.k = 0 THEN {BUDGET} ELSE {BUDGET} - {HISTORY_TOKENS} - s.stokens END AS new) n),
w AS (SELECT DISTINCT conv_id, start, k FROM f),
h AS (
  SELECT w.conv_id, w.k, s.ssize
    + CASE WHEN w.start - 1 >= s.system AND a.tokens <= {HISTORY_TOKENS} THEN a.size ELSE 0 END
    + CASE WHEN w.start - 2 >= s.system AND a.tokens + b.tokens <= {HISTORY_TOKENS} THEN b.size ELSE 0 END AS more
  FROM w JOIN s ON s.conv_id IS NOT DISTINCT FROM w.conv_id
  LEFT JOIN t a ON a.conv_id IS NOT DISTINCT FROM w.conv_id AND a.i = w.start - 1
  LEFT JOIN t b ON b.conv_id IS NOT DISTINCT FROM w.conv_id AND b.i = w.start - 2
  WHERE w.k > 0)
SELECT t.conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(size) + coalesce((SELECT sum(more) FROM h WHERE h.conv_id IS NOT DISTINCT FROM t.conv_id), 0))::BIGINT AS formatted_chars,
  (SELECT count(*) FROM w WHERE w.conv_id IS NOT DISTINCT FROM t.conv_id) AS n_windows
FROM t GROUP BY t.conv_id
"""
