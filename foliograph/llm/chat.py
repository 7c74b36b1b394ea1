"""Chat formatting in budgeted windows.

The turns of a conversation are cut into windows of at most ``budget`` tokens.
Every window begins with the system turns that open the conversation, then
repeats the last turns before the window's own, as many as fit into ``history``
tokens, then has its own turns: the longest run, found in the prefix sums of
the turns' tokens, that fits the budget.  Every turn that is not a system turn
at the start is some window's own exactly once; only an assistant's own turns
are targets, so what is repeated is masked.

Tokens of a turn: runs of word characters, and other single characters that are
not space, plus ``overhead`` for the template's marks.  This count is the same
in SQL; a public tokenizer's vocabulary file can be named instead.

Defined results: turns go by turn number (NULL first), ties by role and text;
NULL or empty text counts as the empty text and NULL role as 'user'; turns of a
NULL conversation are one conversation of id NULL; a turn that does not fit
alone makes a window alone, without history, of more than ``budget`` tokens
(over_budget); a conversation of system turns only has one window without own
turns; repeated rows are repeated turns; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Params:
    budget: int = 512
    history: int = 128
    overhead: int = 4
    tokenizer: str | None = None  #: vocabulary file readable by ``tokenizers``; None counts words and signs


def token_count(text: Column) -> Column:
    """Words and signs of a text."""
    return F.size(F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}_]+|[^\p{L}\p{N}_\s])"), F.lit(1)))


def plan(tokens: np.ndarray, system: int, p: Params) -> list[tuple[int, int, int]]:
    """(first repeated turn, first own turn, one past the last) of each window; the first ``system`` turns open every window."""
    n = len(tokens)
    prefix = np.concatenate([[0], np.cumsum(tokens)])
    fixed = prefix[system]
    if system == n:
        return [(n, n, n)]
    out, at = [], system
    while at < n:
        back = int(np.searchsorted(prefix, prefix[at] - p.history, "left")) if at > system else at
        back = min(at, max(system, back))
        room = p.budget - fixed - (prefix[at] - prefix[back])
        if tokens[at] > room:  # history gives way to the turn
            back = at
            room = p.budget - fixed
        end = int(np.searchsorted(prefix, prefix[at] + room, "right")) - 1
        end = max(end, at + 1)
        out.append((back, at, end))
        at = end
    return out


def windows(conversations: DataFrame, p: Params = Params()) -> DataFrame:
    """One row for each window: conv_id, window, system_turns, first_history, first_turn, end_turn (places from 0), n_tokens, target_tokens, over_budget, text, loss_mask (a 1 or 0 a turn)."""
    if p.tokenizer:
        path = p.tokenizer

        @F.pandas_udf("int")
        def counted(texts: pd.Series) -> pd.Series:
            from tokenizers import Tokenizer

            enc = Tokenizer.from_file(path)
            return pd.Series([len(e.ids) for e in enc.encode_batch(texts.tolist(), add_special_tokens=False)], dtype="int32")
    else:
        counted = token_count
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("user")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    turns = turns.withColumn("n", (counted(F.col("text")) + p.overhead).cast("long")).withColumn("none", F.col("conv_id").isNull()).withColumn("conv_id", F.coalesce("conv_id", F.lit(0)))
    schema = pa.schema([("conv_id", pa.int64()), ("window", pa.int32()), ("system_turns", pa.int32()), ("first_history", pa.int32()), ("first_turn", pa.int32()), ("end_turn", pa.int32()), ("n_tokens", pa.int64()), ("target_tokens", pa.int64()), ("over_budget", pa.bool_()), ("text", pa.string()), ("loss_mask", pa.string())])

    def one(none, conv, role, text, n):
        system = 0
        while system < len(role) and role[system] == "system":
            system += 1
        n = np.asarray(n, np.int64)
        made = [f"<|{r}|>\n{t}\n" for r, t in zip(role, text)]
        for w, (back, at, end) in enumerate(plan(n, system, p)):
            use = [*range(system), *range(back, end)]
            target = [int(i >= at and role[i] == "assistant") for i in use]
            total = int(n[use].sum())
            yield None if none else conv, w, system, back, at, end, total, int(sum(n[i] for i, t in zip(use, target) if t)), total > p.budget, "".join(made[i] for i in use), "".join(map(str, target))

    def run(batches):
        held, key = ([], [], []), None
        rows: list[tuple] = []

        def flush():
            b = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
            rows.clear()
            return b

        for b in batches:
            for none, conv, role, text, n in zip(*(b.column(i).to_pylist() for i in range(5))):
                if (none, conv) != key:
                    if key is not None:
                        rows.extend(one(*key, *held))
                        if len(rows) >= 2000:
                            yield flush()
                    held, key = ([], [], []), (none, conv)
                held[0].append(role)
                held[1].append(text)
                held[2].append(n)
        if key is not None:
            rows.extend(one(*key, *held))
        if rows:
            yield flush()

    order = turns.select("none", "conv_id", "role", "text", "n", F.col("turn").alias("at")).repartition("none", "conv_id").sortWithinPartitions("none", "conv_id", F.col("at").asc_nulls_first(), "role", "text")
    return order.drop("at").mapInArrow(run, "conv_id long, window int, system_turns int, first_history int, first_turn int, end_turn int, n_tokens long, target_tokens long, over_budget boolean, text string, loss_mask string")


def sql(p: Params = Params()) -> str:
    """DuckDB SQL of :func:`windows`: the same plan by a recursive walk over places."""
    return rf"""
WITH RECURSIVE raw AS (
  SELECT conv_id, coalesce(role, 'user') AS role, coalesce(text, '') AS text, turn,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'user'), coalesce(text, '')) - 1 AS i,
         len(regexp_extract_all(coalesce(text, ''), '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]')) + {p.overhead} AS n
  FROM conversations),
t AS (
  SELECT conv_id, role, text, i, n,
         CAST(sum(n) OVER (PARTITION BY conv_id ORDER BY i) AS BIGINT) AS upto,
         CAST(sum(CASE WHEN role <> 'system' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY i) AS BIGINT) AS others
  FROM raw),
c AS (
  SELECT conv_id, count(*) AS turns, count(*) FILTER (WHERE others = 0) AS sys,
         CAST(coalesce(sum(n) FILTER (WHERE others = 0), 0) AS BIGINT) AS fixed,
         list_concat([CAST(0 AS BIGINT)], list(upto ORDER BY i)) AS prefix,
         list(n ORDER BY i) AS ns, list(role ORDER BY i) AS roles, list('<|' || role || '|>' || chr(10) || text || chr(10) ORDER BY i) AS made
  FROM t GROUP BY conv_id),
w AS (
  SELECT conv_id, -1 AS win, sys AS back, sys AS pos, sys AS stop FROM c
  UNION ALL
  SELECT s.conv_id, s.win + 1, s.back, s.pos,
         greatest(s.pos + 1, len(list_filter(s.prefix, lambda x: x <= s.prefix[s.pos + 1] + s.budget - (s.prefix[s.pos + 1] - s.prefix[s.back + 1]))) - 1)
  FROM (
    SELECT *, CASE WHEN ns[pos + 1] > {p.budget} - fixed - (prefix[pos + 1] - prefix[back0 + 1]) THEN pos ELSE back0 END AS back, {p.budget} - fixed AS budget
    FROM (
      SELECT w.conv_id, w.win, w.stop AS pos, c.prefix, c.ns, c.fixed,
             CASE WHEN w.stop > c.sys THEN least(w.stop, greatest(c.sys, len(list_filter(c.prefix, lambda x: x < c.prefix[w.stop + 1] - {p.history})))) ELSE w.stop END AS back0
      FROM w JOIN c USING (conv_id) WHERE w.stop < c.turns)) s),
picked AS (
  SELECT conv_id, win, back, pos, stop FROM w WHERE win >= 0
  UNION ALL SELECT conv_id, 0, turns, turns, turns FROM c WHERE sys = turns),
used AS (
  SELECT p.*, c.sys, c.ns, c.roles, c.made, list_concat(range(0, c.sys), range(p.back, p.stop)) AS use
  FROM picked p JOIN c USING (conv_id))
SELECT conv_id, CAST(win AS INTEGER) AS "window", CAST(sys AS INTEGER) AS system_turns, CAST(back AS INTEGER) AS first_history,
       CAST(pos AS INTEGER) AS first_turn, CAST(stop AS INTEGER) AS end_turn,
       CAST(list_sum(list_transform(use, lambda k: ns[k + 1])) AS BIGINT) AS n_tokens,
       CAST(coalesce(list_sum(list_transform(use, lambda k: CASE WHEN k >= pos AND roles[k + 1] = 'assistant' THEN ns[k + 1] ELSE 0 END)), 0) AS BIGINT) AS target_tokens,
       list_sum(list_transform(use, lambda k: ns[k + 1])) > {p.budget} AS over_budget,
       array_to_string(list_transform(use, lambda k: made[k + 1]), '') AS text,
       array_to_string(list_transform(use, lambda k: CASE WHEN k >= pos AND roles[k + 1] = 'assistant' THEN '1' ELSE '0' END), '') AS loss_mask
FROM used"""
