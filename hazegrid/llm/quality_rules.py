"""Quality rules under weak supervision, in DataFrame functions alone.

Each rule votes junk, votes clean or abstains. Votes are all that is known about a text's quality;
expectation-maximisation estimates from their agreement how often each rule is right on clean and on
junk texts, and a text is kept if its posterior probability of being clean is high enough. No rule
has a veto, and none must be passed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazegrid.llm.common import store

SPACE = r"[ \t-\r]"
#: Rules: share name, junk above, clean below; between them the rule abstains.
RULES = [
    ("symbol_share", 0.03, 0.006),
    ("upper_share", 0.35, 0.15),
    ("repeat_share", 0.30, 0.12),
    ("same_share", 0.10, 0.03),
    ("dup_line_share", 0.40, 0.05),
    ("mark_share", 0.42, 0.25),
    ("rare_share", 0.75, 0.60),
    ("long_word", 13.0, 10.0),
]
#: Beliefs before any vote is seen: prior of clean, a vote's chance of being right on clean and on junk texts, and their weight.
PRIOR, RIGHT_CLEAN, RIGHT_JUNK, WEIGHT = 0.85, 0.97, 0.40, 20.0


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, the five counts, and the shares that the rules look at) of every row.

    A null text has no words; all its counts and shares are 0.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    removed = lambda x, chars: F.length(x) - F.length(F.translate(x, chars, ""))
    base = docs.select(F.col(id_col).alias("__id"), text.alias("t"))
    base = base.withColumns(
        {
            "w": F.array_remove(F.split("t", f"{SPACE}+"), ""),
            "lines": F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^ \t-\r]")),
        }
    )
    # The windows, each with its place, ordered so that equal windows stand side by side.
    window = F.transform("w", lambda x, i: F.struct(F.concat_ws(" ", x, F.get("w", i + 1), F.get("w", i + 2)).alias("g"), i.alias("i")))
    base = base.withColumn("s", F.sort_array(F.slice(window, 1, F.greatest(F.size("w") - 2, F.lit(0)))))
    twin = lambda x, j: F.coalesce(F.get("s", j - 1)["g"] == x["g"], F.lit(False)) | F.coalesce(F.get("s", j + 1)["g"] == x["g"], F.lit(False))
    at = F.sort_array(F.transform(F.filter("s", twin), lambda x: x["i"]))
    # Each repeated window covers three words, less those the window before it covers.
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
    covered = F.aggregate(at, start, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")), lambda a: a["n"])
    same = F.size(F.filter("w", lambda x, i: F.coalesce(F.get("w", i - 1) == x, F.lit(False))))
    out = base.select(
        "__id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.translate("t", " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        removed(F.col("t"), "#*$%&|<>").cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        same.alias("n_same"),
        F.size("lines").alias("n_lines"),
        F.size(F.array_distinct("w")).alias("n_kinds"),
        (F.length("t") - F.length(F.regexp_replace("t", r"\p{Lu}+", ""))).alias("n_upper"),
        (F.length("t") - F.length(F.regexp_replace("t", r"[^\p{L}\p{N}\s]+", ""))).alias("n_marks"),
    )
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return out.select(
        F.col("__id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        share("n_symbols", "word_chars").alias("symbol_share"),
        share("n_upper", "word_chars").alias("upper_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"),
        share("n_same", "n_words").alias("same_share"),
        share("n_dup_lines", "n_lines").alias("dup_line_share"),
        share("n_marks", "n_words").alias("mark_share"),
        # Few kinds of words in a long text; long texts repeat common words, so kinds count against the square root.
        F.when(F.col("n_words") > 0, 1 - F.least(F.lit(1.0), F.col("n_kinds") / (4 * F.sqrt("n_words")))).otherwise(0.0).alias("rare_share"),
        share("word_chars", "n_words").alias("long_word"),
    )


def votes(counted: DataFrame, rules=RULES) -> DataFrame:
    """``counted`` with a vote for each rule: -1 junk, 1 clean, 0 abstains. Texts without words get no vote."""
    vote = lambda c, junk, clean: F.when(F.col("n_words") == 0, 0).when(F.col(c) > junk, -1).when(F.col(c) < clean, 1).otherwise(0)
    return counted.withColumns({f"v_{c}": vote(c, junk, clean).cast("int") for c, junk, clean in rules})


def posterior(names: list[str], prior: float, right_clean: dict[str, float], right_junk: dict[str, float]) -> Column:
    """Probability of clean, given the votes."""
    lit = F.lit

    def weight(v: str) -> Column:
        up = F.log(lit(right_clean[v])) - F.log(lit(1 - right_junk[v]))
        down = F.log(lit(1 - right_clean[v])) - F.log(lit(right_junk[v]))
        return F.when(F.col(v) > 0, up).when(F.col(v) < 0, down).otherwise(lit(0.0))

    odds = reduce(lambda a, b: a + b, [weight(v) for v in names], F.log(lit(prior)) - F.log(lit(1 - prior)))
    return 1 / (1 + F.exp(-odds))


def estimate(voted: DataFrame, names: list[str], rounds: int = 25, tolerance: float = 1e-4) -> tuple[float, dict, dict]:
    """Prior and rule accuracies by expectation-maximisation over the counts of vote patterns.

    All rows are counted once; there are at most 3**rules patterns, however many rows. Beliefs count
    as ``WEIGHT`` votes, so a rule that hardly votes keeps them, and an empty table changes nothing.
    """
    patterns = store(voted.groupBy(*names).agg(F.count("*").alias("n"))).coalesce(1)
    prior, clean, junk = PRIOR, dict.fromkeys(names, RIGHT_CLEAN), dict.fromkeys(names, RIGHT_JUNK)
    for _ in range(rounds):
        p = posterior(names, prior, clean, junk)
        sums = [F.sum(F.col("n") * F.col("p")).alias("c"), F.sum("n").alias("n")]
        for v in names:
            up, down = F.when(F.col(v) > 0, F.col("n")).otherwise(0), F.when(F.col(v) < 0, F.col("n")).otherwise(0)
            sums += [
                F.sum(up * F.col("p")).alias(f"{v}_uc"), F.sum(down * F.col("p")).alias(f"{v}_dc"),
                F.sum(up * (1 - F.col("p"))).alias(f"{v}_uj"), F.sum(down * (1 - F.col("p"))).alias(f"{v}_dj"),
            ]
        row = patterns.withColumn("p", p).agg(*sums).first()
        got = {k: row[k] or 0.0 for k in row.asDict()}
        old = [prior, *clean.values(), *junk.values()]
        prior = (got["c"] + WEIGHT * PRIOR) / (got["n"] + WEIGHT)
        clean = {v: (got[f"{v}_uc"] + WEIGHT * RIGHT_CLEAN) / (got[f"{v}_uc"] + got[f"{v}_dc"] + WEIGHT) for v in names}
        junk = {v: (got[f"{v}_dj"] + WEIGHT * RIGHT_JUNK) / (got[f"{v}_dj"] + got[f"{v}_uj"] + WEIGHT) for v in names}
        if max(abs(a - b) for a, b in zip(old, [prior, *clean.values(), *junk.values()], strict=True)) < tolerance:
            break
    return prior, clean, junk


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_above: float = 0.5, rules=RULES) -> DataFrame:
    """(id_col, the five counts, base_failed, p_clean, kept), one row for each row of ``docs``.

    ``base_failed``: fewer than 50 words, or more than half of them in repeated three-word windows.
    ``kept`` is false then, else ``p_clean >= keep_above``. Null and empty texts have no words and
    fail. Repeated rows repeat; a null id is kept as it is; an empty table gives no rows.
    """
    voted = store(votes(counts(docs, id_col, text_col), rules))
    names = [f"v_{c}" for c, _, _ in rules]
    p = posterior(names, *estimate(voted, names))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return voted.withColumn("base_failed", failed).withColumn("p_clean", p).select(
        id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "p_clean",
        (~F.col("base_failed") & (F.col("p_clean") >= keep_above)).alias("kept"),
    )
