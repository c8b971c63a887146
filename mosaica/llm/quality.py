"""Quality rules as weak supervision, in DataFrame functions only.

Each rule votes good, bad or abstains on a document. How votes fall in good and in bad documents (the rules' accuracies), and how
many documents are good, is estimated by expectation-maximisation over the counts of vote patterns; a document is kept when
its posterior probability of being good reaches one half. No labels are used. Documents that fail the base take no part in it.

Scale: features are column expressions over one read of the texts, without a shuffle. The patterns' counts are at most 3 ** rules
rows (2,187), however many documents there are, so they are collected once, EM runs on the driver over them, and the broadcast of
posteriors has a proven bound.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: name, when it votes bad, when it votes good; else it abstains. Most rules know one kind of junk and stay silent on all else, so
#: that a document with one fault isn't outvoted by rules that look at other faults; prose and length speak for a document.
RULES = [
    ("symbols", "n_symbols >= 0.30 * n_words", "false"),
    ("capitals", "n_upper >= 0.50 * word_chars", "false"),
    ("marks", "n_marks >= 0.30 * n_words", "false"),
    ("dup_lines", "n_dup_lines >= 0.50 * n_lines", "false"),
    ("word_length", "word_chars < 2.0 * n_words or word_chars > 11.0 * n_words", "false"),
    ("prose", "false", "n_symbols <= 0.15 * n_words and n_upper <= 0.25 * word_chars and n_marks <= 0.15 * n_words and n_dup_lines <= 0.40 * n_lines and n_repeat_words <= 0.15 * n_words"),
    ("length", "n_words < 10", "n_words >= 40 and n_symbols <= 0.20 * n_words and n_marks <= 0.20 * n_words"),
]
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks", "n_lines"]
#: Seen in every class once, so that no estimate is 0 or 1.
SMOOTHING = 1.0

_REPEATED = """
case when size(w) < 6 then 0L else
  aggregate(transform(array(transform(w, x -> xxhash64(x))), h ->
    transform(array(transform(sequence(0, size(h) - 5), i -> xxhash64(h[i], h[i + 1], h[i + 2], h[i + 3], h[i + 4]))), g ->
      case when size(array_distinct(g)) = size(g) then 0L else
        aggregate(transform(array(array_sort(transform(g, (v, i) -> struct(v as v, i as i)))), p ->
          aggregate(transform(array(array_sort(transform(
              filter(p, (x, k) -> (k > 0 and p[k - 1].v = x.v) or (k < size(p) - 1 and p[k + 1].v = x.v)), x -> x.i))), s ->
            aggregate(transform(s, (x, k) -> cast(least(5, coalesce(get(s, k + 1) - x, 5)) as bigint)), 0L, (a, x) -> a + x)),
          0L, (a, x) -> a + x)), 0L, (a, x) -> a + x)
      end)[0]), 0L, (a, x) -> a + x)
end
"""


def measures(docs: DataFrame, text_col: str = "text", into: str = "measures") -> DataFrame:
    """The documents with a struct column of the measures, all long; null text: no words, all zero.

    Words are longest runs of [^\\x20\\x09-\\x0D]; n_dup_lines counts the lines with a word that equal an earlier line; n_repeat_words
    the words inside 5-word windows that stand twice or more in the text. Windows are told apart by 64-bit hashes.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    body = F.struct(
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[ \\t-\\r]+")).alias("w"),
        F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\x0b\x0c\r")) != "")).alias("l"),
        text.alias("t"),
    )
    found = """named_struct(
      'n_words', cast(size(b.w) as bigint), 'word_chars', cast(length(b.t) - regexp_count(b.t, '[ \\\\t-\\\\r]') as bigint),
      'n_symbols', cast(regexp_count(b.t, '[#*$%&|<>]') as bigint), 'n_dup_lines', cast(size(b.l) - size(array_distinct(b.l)) as bigint),
      'n_repeat_words', REPEATED, 'n_upper', cast(regexp_count(b.t, '\\\\p{Lu}') as bigint), 'n_marks', cast(regexp_count(b.t, '!') as bigint),
      'n_lines', cast(size(b.l) as bigint))""".replace("REPEATED", _REPEATED.replace("size(w)", "size(b.w)").replace("transform(w,", "transform(b.w,"))
    parts = common.fresh([*docs.columns, into], "body")
    return docs.withColumn(parts, body).withColumn(into, F.expr(f"transform(array({parts}), b -> {found})[0]")).drop(parts)


def base_failed(m: str = "measures") -> Column:
    return F.expr(f"{m}.n_words < 10 or 100 * {m}.n_repeat_words > 20 * {m}.n_words")


def votes(m: str = "measures") -> Column:
    """The vote pattern as one number: a digit of base 3 for each rule (0 abstains, 1 good, 2 bad)."""
    code = "0"
    for _, bad, good in RULES:
        bad, good = (re.sub(r"\b(n_\w+|word_chars)\b", rf"{m}.\1", x) for x in (bad, good))
        code = f"({code}) * 3 + case when {bad} then 2 when {good} then 1 else 0 end"
    return F.expr(f"cast({code} as int)")


def accuracies(patterns: list[tuple[int, int]], rounds: int = 200, tolerance: float = 1e-7) -> dict:
    """EM over pattern counts (code, n): {"good": share, "table": {rule: (P(vote|good) x 3, P(vote|bad) x 3)}, "p_good": {code: P(good | votes)}}.

    The start says that votes are mostly right and nine documents in ten good, so the classes can't swap. Rounds end when no estimate moves
    by ``tolerance``. No patterns: the start values.
    """
    k = len(RULES)
    good, table = 0.9, [((0.3, 0.67, 0.03), (0.6, 0.1, 0.3)) for _ in RULES]
    rows = [([code // 3 ** (k - 1 - j) % 3 for j in range(k)], n) for code, n in sorted(patterns)]
    for _ in range(rounds if rows else 0):
        sums = [[[0.0] * 3 for _ in range(k)] for _ in "gb"]
        share = [0.0, 0.0]
        for digits, n in rows:
            g = n * posterior(good, table, digits)
            for side, weight in enumerate((g, n - g)):
                share[side] += weight
                for j, v in enumerate(digits):
                    sums[side][j][v] += weight
        old = good, table
        good = (share[0] + SMOOTHING) / (sum(share) + 2 * SMOOTHING)
        table = [tuple(tuple((x + SMOOTHING) / (share[side] + 3 * SMOOTHING) for x in sums[side][j]) for side in (0, 1)) for j in range(k)]
        moved = max([abs(good - old[0]), *(abs(x - y) for now, then in zip(table, old[1], strict=True) for a, b in zip(now, then, strict=True) for x, y in zip(a, b, strict=True))])
        if moved < tolerance:
            break
    return {"good": good, "table": {name: t for (name, *_), t in zip(RULES, table, strict=True)}, "p_good": {code: posterior(good, table, d) for (code, _), (d, _) in zip(sorted(patterns), rows, strict=True)}}


def posterior(good: float, table: list, digits: list[int]) -> float:
    """P(good | votes)."""
    odds = math.log(good / (1 - good)) + sum(math.log(g[v] / b[v]) for (g, b), v in zip(table, digits, strict=True))
    return 1 / (1 + math.exp(-odds))


def fitted(coded: DataFrame) -> DataFrame:
    """code, p_good for every vote pattern of ``coded`` (column code, null: no part in it), as literal rows: 3 ** rules at most."""
    counts = coded.where("code is not null").groupBy("code").agg(F.count("*").alias("n")).collect()
    chances = accuracies([(r.code, r.n) for r in counts])["p_good"]
    return coded.sparkSession.createDataFrame(sorted(chances.items()), "code int, p_good double")


def judged(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, the measures, votes, base_failed, p_good, kept.

    kept is false where base_failed (fewer than 10 words, or over 20 % of the words repeated), else whether p_good >= 0.5; p_good and
    votes are null where base_failed. Null or empty text fails the base. A very long text is one row's arrays in one task: memory of some
    50 times its bytes. Ties of the posterior (0.5) are kept; repeated rows are judged alike and each counts in the estimates; rows
    without an id are judged as any other; an empty table gives no rows; other columns are ignored.
    """
    rows = measures(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), into="m")
    rows = common.written(rows.select("doc_id", "m.*", F.when(~base_failed("m"), votes("m")).alias("votes"), base_failed("m").alias("base_failed")), "measures")
    chance = fitted(rows.select(F.col("votes").alias("code")))
    out = rows.join(F.broadcast(chance.withColumnRenamed("code", "votes")), "votes", "left")
    return out.withColumn("kept", F.coalesce(F.col("p_good") >= 0.5, F.lit(False))).select("doc_id", *MEASURES, "votes", "base_failed", "p_good", "kept")


def keep(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """The documents that are kept, with their own columns whatever their names; the texts are read twice and not shuffled.

    Null, empty and base-failed texts go; ties, very long texts and repeated rows as in ``judged``; an empty table stays empty.
    """
    m, code = common.fresh(docs.columns, "measures"), common.fresh(docs.columns, "votes")
    coded = measures(docs, text_col, m)
    coded = coded.withColumn(code, F.when(~base_failed(m), votes(m))).drop(m)
    every = measures(docs.select(text_col), text_col, m).select(F.when(~base_failed(m), votes(m)).alias("code"))
    chance = fitted(every).where("p_good >= 0.5").select(F.col("code").alias(code))
    return coded.join(F.broadcast(chance), code, "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))
