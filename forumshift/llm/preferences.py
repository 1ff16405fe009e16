"""Operator 8 (native): preference formatting of conversations.

A pair of conversations (chosen, rejected) is cut at their longest common prefix of turns.
The prefix is rendered once as the prompt; what follows on each side is its completion.
Each side comes with segments and a loss mask: only text that the assistant wrote after
the prompt (and the end mark of those turns) counts.  Everything is array and string
expressions over one row per conversation.

Pairs of the registered query: conversations that open with the same turn form a group;
the one with the longest last answer is chosen, each other of the group is rejected
against it (one aggregate with a partial step and one join per group, never all pairs of a
group).  A conversation with two answers or more also has a rejected twin in which the
last answer is replaced by the one before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import LlmQuery
from .common import table, written

# fixed values: the chat template
OPEN, ROLE_END, TURN_END = "<|im_start|>", "\n", "<|im_end|>\n"
ASSISTANT = "assistant"
TURN = "struct<role:string,text:string>"
#: parts into which the conversations of one opening are dealt for the join with their best
SHARES = 16


def conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                  text_col: str = "text") -> DataFrame:
    """``(id, turns)``: one row per conversation, turns in order (equal turn numbers by role
    and text, null numbers last); repeated equal turns stay.  Ids may have any type.  Null roles are 'user', null
    texts empty.  Rows without a conversation id belong to no conversation."""
    t = turns.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(turn_col).isNull().alias("last"), F.col(turn_col).cast("long").alias("n"),
        F.lower(F.coalesce(F.col(role_col).cast("string"), F.lit("user"))).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return (t.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("last", "n", "role", "text"))).alias("t"))
            .select("id", F.transform("t", lambda x: F.struct(x.role.alias("role"), x.text.alias("text"))).alias("turns")))


def common_prefix(a: Column, b: Column) -> Column:
    """Number of leading equal turns."""
    differ = F.array_position(F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda x: x.a.eqNullSafe(x.b)), False)
    return F.when(differ > 0, differ - 1).otherwise(F.least(F.size(a), F.size(b))).cast("int")


def render(turns: Column) -> Column:
    """The turns in the chat template."""
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t.role, F.lit(ROLE_END), t.text, F.lit(TURN_END))), "")


def masked(turns: Column) -> Column:
    """Segments ``(text, loss)`` of a completion: loss on what the assistant wrote."""
    def parts(t):
        head = F.concat(F.lit(OPEN), t.role, F.lit(ROLE_END))
        said = F.concat(t.text, F.lit(TURN_END))
        return F.array(F.struct(head.alias("text"), F.lit(0).alias("loss")),
                       F.struct(said.alias("text"), F.when(t.role == ASSISTANT, 1).otherwise(0).alias("loss")))
    return F.flatten(F.transform(turns, parts))


def preference_pairs(pairs: DataFrame) -> DataFrame:
    """``pairs(pair_id, chosen, rejected)`` with arrays of turns -> ``(pair_id, n_common,
    prompt, chosen, rejected, chosen_mask, rejected_mask)``.

    Null conversations count as empty.  Pairs of equal conversations say nothing and are
    left out; a conversation that is a prefix of the other has an empty completion; pairs
    without a common turn have an empty prompt.  Repeated pairs stay.
    """
    empty = F.expr(f"cast(array() AS array<{TURN}>)")
    a, b = F.coalesce("chosen", empty), F.coalesce("rejected", empty)
    p = pairs.select("pair_id", a.alias("a"), b.alias("b")).withColumn("n", common_prefix(F.col("a"), F.col("b")))
    p = p.filter((F.col("n") < F.size("a")) | (F.col("n") < F.size("b")))
    rest_a = F.slice("a", F.col("n") + 1, F.greatest(F.size("a") - F.col("n"), F.lit(0)))
    rest_b = F.slice("b", F.col("n") + 1, F.greatest(F.size("b") - F.col("n"), F.lit(0)))
    return p.select("pair_id", F.col("n").cast("long").alias("n_common"), render(F.slice("a", F.lit(1), F.col("n"))).alias("prompt"),
                    render(rest_a).alias("chosen"), render(rest_b).alias("rejected"),
                    masked(rest_a).alias("chosen_mask"), masked(rest_b).alias("rejected_mask"))


def derived_pairs(conv: DataFrame) -> DataFrame:
    """``(pair_id, chosen, rejected)`` from conversations ``(id, turns)`` (see the module)."""
    conv = conv.filter(F.size("turns") > 0)
    key = F.struct(F.sha2(F.to_json(F.try_element_at("turns", F.lit(1))), 256).alias("k"))
    answers = F.filter("turns", lambda t: t.role == ASSISTANT)
    last = F.coalesce(F.length(F.try_element_at(answers, F.lit(-1)).text), F.lit(-1))
    keyed = conv.select("id", "turns", key.alias("key"), last.alias("score"))
    best = (keyed.groupBy("key").agg(F.min_by("id", F.struct((-F.col("score")).alias("s"), "id")).alias("best"), F.count("*").alias("n"))
            .filter("n > 1").select("key", "best"))
    # the best of each opening, with its turns, once for each share of the opening's conversations
    chosen = (keyed.select(F.col("id").alias("best"), F.col("turns").alias("chosen")).join(best, "best")
              .withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1)))))
    against = (keyed.withColumn("share", F.pmod(F.xxhash64("id"), F.lit(SHARES)).cast("int")).join(chosen, ["key", "share"]).filter("id <> best")
               .select(F.struct(F.lit("opening").alias("kind"), F.col("best").alias("chosen_id"), F.col("id").alias("rejected_id")).alias("pair_id"),
                       "chosen", F.col("turns").alias("rejected")))
    places = F.filter(F.transform("turns", lambda t, i: F.when(t.role == ASSISTANT, i + 1)), lambda i: i.isNotNull())
    twin = (conv.select("id", "turns", places.alias("at")).filter(F.size("at") > 1)
            .select("id", "turns", F.try_element_at("at", F.lit(-1)).alias("z"), F.try_element_at("at", F.lit(-2)).alias("y"))
            .select("id", F.slice("turns", F.lit(1), F.col("z")).alias("chosen"),
                    F.concat(F.slice("turns", F.lit(1), F.col("z") - 1), F.slice("turns", F.col("y"), F.lit(1))).alias("rejected"))
            .select(F.struct(F.lit("stale").alias("kind"), F.col("id").alias("chosen_id"), F.col("id").alias("rejected_id")).alias("pair_id"),
                    "chosen", "rejected"))
    return against.unionByName(twin)


SQL = r"""
WITH t AS (SELECT conv_id AS id, list({'role': lower(coalesce(role, 'user')), 'text': coalesce(text, '')}
                 ORDER BY turn NULLS LAST, lower(coalesce(role, 'user')), coalesce(text, '')) AS turns
           FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
scored AS (SELECT id, turns, turns[1] AS first,
                  coalesce(length(list_filter(turns, lambda x: x.role = 'assistant')[-1].text), -1) AS score,
                  list_filter(list_transform(turns, lambda x, i: CASE WHEN x.role = 'assistant' THEN i END), lambda i: i IS NOT NULL) AS places FROM t),
best AS (SELECT first, arg_max(id, (score, -id)) AS best FROM scored GROUP BY 1 HAVING count(*) > 1),
pairs AS (
  SELECT 'opening' AS kind, best AS chosen_id, s.id AS rejected_id, c.turns AS a, s.turns AS b
  FROM scored s JOIN best USING (first) JOIN scored c ON c.id = best WHERE s.id <> best
  UNION ALL
  SELECT 'stale', id, id, turns[1:places[-1]], list_concat(turns[1:places[-1] - 1], [turns[places[-2]]]) FROM scored WHERE len(places) > 1),
cut AS (SELECT *, coalesce(list_position(list_transform(range(1, least(len(a), len(b)) + 1), lambda i: a[i] = b[i]), false) - 1,
                           least(len(a), len(b))) AS n FROM pairs),
rest AS (SELECT kind, chosen_id, rejected_id, n, a[1:n] AS p, a[n + 1:] AS x, b[n + 1:] AS y FROM cut WHERE n < len(a) OR n < len(b)),
said AS (SELECT kind, chosen_id, rejected_id, n::BIGINT AS n_common,
  array_to_string(list_transform(p, lambda t: '<|im_start|>' || t.role || chr(10) || t.text || '<|im_end|>' || chr(10)), '') AS prompt,
  array_to_string(list_transform(x, lambda t: '<|im_start|>' || t.role || chr(10) || t.text || '<|im_end|>' || chr(10)), '') AS chosen,
  array_to_string(list_transform(y, lambda t: '<|im_start|>' || t.role || chr(10) || t.text || '<|im_end|>' || chr(10)), '') AS rejected,
  array_to_string(list_transform(x, lambda t: '0:' || (length(t.role) + 13) || ' ' || CASE WHEN t.role = 'assistant' THEN 1 ELSE 0 END || ':' || (length(t.text) + 11)), ' ') AS chosen_mask,
  array_to_string(list_transform(y, lambda t: '0:' || (length(t.role) + 13) || ' ' || CASE WHEN t.role = 'assistant' THEN 1 ELSE 0 END || ':' || (length(t.text) + 11)), ' ') AS rejected_mask
  FROM rest)
SELECT kind, chosen_id, rejected_id, n_common, prompt, chosen, rejected, chosen_mask, rejected_mask FROM said
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt and masked completions of every pair; a mask is loss:length of each segment."""
    conv = written(conversations(table(spark, sf_dir, "conversations")), "conversations")
    p = preference_pairs(derived_pairs(conv))

    def digest(mask):
        return F.array_join(F.transform(mask, lambda s: F.concat_ws(":", s.loss.cast("string"), F.length(s.text).cast("string"))), " ")
    return p.select("pair_id.*", "n_common", "prompt", "chosen", "rejected",
                    digest(F.col("chosen_mask")).alias("chosen_mask"), digest(F.col("rejected_mask")).alias("rejected_mask"))


QUERY = LlmQuery("op8_preference_format", query, SQL)
