"""Line dedup by a log-template tree.

A line's tokens are masked where they vary by nature (anything with a digit). The tree has a fixed
depth: its branches are the number of tokens and the leading tokens, its leaves hold templates. In a
leaf, a line joins the most similar template if enough of its tokens agree, and where they differ the
template becomes general. A template that recurs across documents is boilerplate: its first document
keeps it, every other document loses those lines. Short lines have too few tokens for a similarity:
equal masked ones are one template, which recurs if more documents hold it than chance explains.
"""

from __future__ import annotations

from functools import reduce
from operator import eq, or_

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazegrid.llm.common import components, small_batches, store

FIELD = "<*>"
#: Distinct lines of a leaf from which on its lines are linked, so that lines that can't meet are parsed apart.
PART = 20_000
#: Rows of a broadcast side; it is counted first, and a larger one is joined by shuffling.
BROADCAST_ROWS = 1_000_000


def masked(line: Column) -> Column:
    """Tokens joined by one space, with those that hold a digit replaced by the field mark."""
    # Plain substring tests: most lines need no pattern at all.
    untidy = reduce(or_, [line.contains(x) for x in ("  ", "\t", "\r", "\x0b", "\f")], line.startswith(" ") | line.endswith(" "))
    tidy = F.when(untidy, F.trim(F.regexp_replace(line, r"\s+", " "))).otherwise(line)
    return F.when(tidy.rlike("[0-9]"), F.regexp_replace(tidy, r"(?<!\S)[^\s\d]*+\d\S*", FIELD)).otherwise(tidy)


def leaf_key(m: Column, tokens: Column, depth: int) -> Column:
    return F.xxhash64(tokens, F.substring_index(m, " ", depth))


def tail_key(m: Column, tokens: Column, depth: int) -> Column:
    """Leaf of the second tree, whose branches are the last tokens."""
    return F.xxhash64(tokens, F.substring_index(m, " ", -depth), F.lit("tail"))


def tokens(name: str) -> Column:
    """Number of tokens of a masked line."""
    return F.length(name) - F.length(F.replace(F.col(name), F.lit(" "), F.lit(""))) + 1


def segments(tokens: list[str], similarity: float, depth: int, tail: bool) -> tuple[list[tuple], int]:
    """Segments of a line behind its branch tokens, and how many of them are enough to look under.

    Lines of a leaf share the branch tokens, so all that a line may miss lies in the rest. The rest is cut into twice
    as many segments as it takes: of any ``enough`` of them, one more than the tokens a line may miss, at least one
    agrees whole with a line that is near enough. A rest too short for that is one segment that all lines share.
    """
    misses = int(len(tokens) * (1 - similarity) + 1e-9)
    rest = tokens[: max(0, len(tokens) - depth)] if tail else tokens[depth:]
    n, enough = len(rest), misses + 1
    if n < enough:
        return [(0,)], 1
    k = min(n, 2 * enough)
    return [(i, *rest[n * i // k : n * (i + 1) // k]) for i in range(k)], enough


class Leaf:
    """Templates of one leaf.

    A line that agrees with a template in a share ``similarity`` of its n tokens misses at most
    (1 - similarity) * n of them: the rarest segments, one more than that, lead to all candidates, and
    none is lost. A general token agrees with nothing.
    """

    def __init__(self, similarity: float, depth: int, tail: bool = False):
        self.similarity, self.depth, self.tail = similarity, depth, tail
        self.templates: list[list[str | None]] = []
        self.by_segment: dict[tuple, list[int]] = {}

    def add(self, tokens: list[str]) -> int:
        """Number of the template the line joins: of the most similar the oldest; a new one if none is near enough."""
        best, at = 0, -1
        own, enough = segments(tokens, self.similarity, self.depth, self.tail)
        shelves = sorted((self.by_segment.get(s, ()) for s in own), key=len)[:enough]
        for t in sorted({t for shelf in shelves for t in shelf}):
            same = sum(map(eq, self.templates[t], tokens))
            if same > best:
                best, at = same, t
        if at >= 0 and best >= self.similarity * len(tokens) - 1e-9:
            self.templates[at] = [a if a == b else None for a, b in zip(self.templates[at], tokens, strict=True)]
            return at
        self.templates.append(list(tokens))
        for s in own:
            self.by_segment.setdefault(s, []).append(len(self.templates) - 1)
        return len(self.templates) - 1


def _parser(similarity: float, depth: int):
    """Parse rows sorted by leaf and component and then by line; ``t`` is a template's number in its component."""

    def parse(batches):
        now, tree = None, None
        for batch in batches:
            out = []
            for leaf, component, tail, line in zip(batch["leaf"], batch["component"], batch["tail"], batch["m"], strict=True):
                if (leaf, component) != now:
                    now, tree = (leaf, component), Leaf(similarity, depth, tail)
                out.append(tree.add(line.split(" ")))
            yield batch.assign(t=out)

    return parse


def _segment_rows(similarity: float, depth: int):
    """(node, segment, enough) of each line; segments of a leaf have numbers of their own."""

    def rows(batches):
        for batch in batches:
            node, segment, takes = [], [], []
            for leaf, n, tail, m in zip(batch["leaf"], batch["node"], batch["tail"], batch["m"], strict=True):
                own, enough = segments(m.split(" "), similarity, depth, tail)
                node += [n] * len(own)
                takes += [enough] * len(own)
                named = (f"{leaf} {i} {' '.join(part)}".encode("utf-8", "surrogatepass") for i, *part in own)
                segment += [xxhash.xxh64_intdigest(x) - (1 << 63) for x in named]
            yield pd.DataFrame({"node": pd.Series(node, dtype="int64"), "segment": pd.Series(segment, dtype="int64"), "enough": pd.Series(takes, dtype="int32")})

    return rows


def near_lines(nodes: DataFrame, similarity: float, depth: int) -> DataFrame:
    """Links (a, b) between lines (node, leaf, tail, m) that make every two near ones of a leaf connected.

    Each line looks under its rarest segments, rare by a count over all lines: of two near lines, the rarest segment
    they share is among these of both. So what many lines have in common links none of them. A segment's lines are
    linked to its first one.
    """
    cut = store(nodes.select("leaf", "node", "tail", "m").mapInPandas(_segment_rows(similarity, depth), "node long, segment long, enough int"))
    shelf = cut.groupBy("segment").agg(F.count("*").alias("n")).where("n > 1")
    # Segments of one line are the rarest of all; they take a place and link nothing.
    ranked = cut.join(shelf, "segment", "left").groupBy("node", "enough").agg(
        F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(1)).alias("n"), "segment"))).alias("own")
    )
    looked = store(ranked.select("node", F.explode(F.slice("own", 1, F.col("enough"))).alias("s")).where("s.n > 1").select("node", "s.segment"))
    first = looked.groupBy("segment").agg(F.min("node").alias("b"))
    return looked.join(first, "segment").where("node <> b").select(F.col("node").alias("a"), "b")


def templates(lines: DataFrame, similarity: float = 0.8, part: int = PART, depth: int = 4) -> DataFrame:
    """(leaf, h, template) for distinct masked lines (leaf, tail, h, m); ``tail`` says which tree a leaf is of.

    Every leaf gives what the tree gives that takes all its lines in order. A line can only join a
    template whose first line is near it, so lines that no chain of near lines links never meet. Leaves
    of more than ``part`` lines fall into such components, parsed apart; as a component holds all that
    its lines can meet, that changes nothing in the result.
    """
    lines = lines.select("leaf", "tail", "h", "m")
    large = store(lines.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") > part).select("leaf"))
    dealt = lines.withColumn("component", F.lit(0).cast("long"))
    if not large.isEmpty():
        nodes = store(lines.join(large, "leaf", "left_semi").withColumn("node", F.xxhash64("leaf", "h")))
        linked = components(near_lines(nodes, similarity, depth))
        alone = F.coalesce("component", "node").alias("component")
        apart = nodes.join(linked, "node", "left").select("leaf", "tail", "h", "m", alone)
        dealt = dealt.join(large, "leaf", "left_anti").unionByName(apart)
    ordered = dealt.repartition("leaf", "component").sortWithinPartitions("leaf", "component", "m", "h")
    schema = "leaf long, tail boolean, h long, m string, component long, t long"
    parsed = ordered.select("leaf", "tail", "h", "m", "component").mapInPandas(_parser(similarity, depth), schema)
    return store(parsed.select("leaf", "h", F.xxhash64("component", "t").alias("template")))


def recurring_short(rows: DataFrame, least: int) -> DataFrame:
    """(h, first) of the masked lines (id, h, k, m) that ``least`` documents or more hold and chance does not explain.

    By chance, a line of k tokens is in as many documents as there are document-line pairs of k tokens
    times the product of its tokens' shares. A share counts what the other lines of k tokens have of the
    token, so that a line does not explain its own repeats. Six deviations above that count are no chance. Lines of
    fields alone have no wording that could recur.
    """
    once = rows.groupBy("id", "h").agg(F.min("k").alias("k"), F.min("m").alias("m"))
    lines = store(once.groupBy("h").agg(F.count("*").alias("docs"), F.min("id").alias("first"), F.min("k").alias("k"), F.min("m").alias("m")))
    words = F.split("m", " ")
    shares = lines.select("k", "docs", F.explode(words).alias("token")).groupBy("k", "token").agg(F.sum("docs").alias("c"))
    pairs = lines.groupBy("k").agg(F.sum("docs").alias("pairs"))
    often = lines.where(F.col("docs") >= least).where(F.exists(words, lambda x: x != FIELD)).withColumn("words", words)
    own = F.col("docs") * F.size(F.filter("words", lambda x: x == F.col("token")))
    told = often.withColumn("token", F.explode("words")).join(shares, ["k", "token"]).join(F.broadcast(pairs), "k")
    # One more than the others have, so that no share is zero.
    share = (F.col("c") - own + 1) / (F.col("k") * F.col("pairs"))
    by_line = told.groupBy("h", "first", "docs", "pairs").agg(F.exp(F.sum(F.log(share))).alias("p"))
    chance = F.col("pairs") * F.col("p")
    return by_line.where(F.col("docs") > chance + 6 * F.sqrt(chance)).select("h", "first")


def recurring(
    docs: DataFrame, id_col: str, text_col: str, min_tokens: int, depth: int, similarity: float, short_docs: int, ends: bool
) -> tuple[DataFrame, DataFrame]:
    """Two stored tables: (id, leaf, h) of all lines that can be templates, and (leaf, h, first) of those that recur.

    ``first`` is the smallest id that has a line of the template; ``leaf`` and ``h`` stand for the masked line.
    Short lines have leaf 0.
    """
    small_batches(docs.sparkSession)
    line = F.explode(F.split(F.col(text_col).cast("string"), "\n"))
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), line.alias("line"))
    rows = rows.select("id", masked(F.col("line")).alias("m")).where("m <> ''").withColumn("k", tokens("m"))
    leaf = F.when(F.col("k") >= min_tokens, leaf_key(F.col("m"), F.col("k"), depth)).otherwise(0)
    lines = store(rows.select("id", leaf.alias("leaf"), F.xxhash64("m").alias("h"), "k", "m"))
    keyed = lines.where(F.col("k") >= min_tokens).withColumn("tail", F.lit(False))
    if ends:
        tail = tail_key(F.col("m"), F.col("k"), depth)
        trees = F.array(F.struct(F.lit(False).alias("tail"), "leaf"), F.struct(F.lit(True).alias("tail"), tail.alias("leaf")))
        keyed = keyed.withColumn("tree", F.explode(trees)).select("id", "h", "k", "m", "tree.*")
    leaves = keyed.groupBy("leaf", "tail").agg(*[f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in ("id", "h")])
    # Equal lines have met in the first tree; the second is for lines that differ.
    shared = store(leaves.where("min_id < max_id AND (NOT tail OR min_h < max_h)").select("leaf"))
    # Few enough leaves go to every task, so that lines of other leaves never move; more are joined by shuffling.
    few = shared.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    # Equal lines collapse before anything is parsed: a line in a third of all documents is one row.
    distinct = store(
        keyed.join(F.broadcast(shared) if few else shared, "leaf").groupBy("leaf", "tail", "h")
        .agg(F.min("m").alias("m"), F.min("id").alias("lo"), F.max("id").alias("hi"))
    )
    named = templates(distinct, similarity, depth=depth)
    spread = distinct.select("leaf", "h", "lo", "hi").join(named, ["leaf", "h"])
    spans = spread.groupBy("leaf", "template").agg(F.min("lo").alias("first"), F.max("hi").alias("last")).where("first < last")
    gone = spread.join(spans.drop("last"), ["leaf", "template"]).where("hi > first").select("leaf", "h", "first")
    short = recurring_short(lines.where(F.col("k") < min_tokens), short_docs).select(F.lit(0).cast("long").alias("leaf"), "h", "first")
    held = keyed.select("id", "leaf", "h").unionByName(lines.where(F.col("k") < min_tokens).select("id", "leaf", "h"))
    return held, store(gone.select("leaf", "h", "first").unionByName(short))


def drop_recurring(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    min_tokens: int = 8, depth: int = 4, similarity: float = 0.8, short_docs: int = 10,
    ends: bool = False,
) -> DataFrame:
    """``docs`` with the lines of recurring templates gone from all but the template's first document.

    Adds ``n_lines`` and ``n_dropped`` (long; columns of those names are replaced). Every row stays,
    with all its other columns. A line recurs if its template stands in two documents or more. Of fewer
    than ``min_tokens`` tokens only equal masked lines are one template, and as short prose recurs by
    chance, it must stand in ``short_docs`` documents and in more than chance gives. With ``ends`` a
    second tree branches by the last ``depth`` tokens, so that an edit among the first ones hides
    nothing; a line goes if either tree has an earlier document of its template. Null
    texts stay null with no lines; an empty text is one empty line. Rows with a null id keep all their
    lines and are no document. Rows of one id are one document. An empty table gives no rows.
    """
    keyed, gone = recurring(docs, id_col, text_col, min_tokens, depth, similarity, short_docs, ends)
    drops = keyed.join(gone, ["leaf", "h"]).where("id > first").groupBy("id").agg(F.collect_set("h").alias("__drop"))
    drops = store(drops.withColumnRenamed("id", "__id"))
    n_drops, n_hashes = drops.agg(F.count("*"), F.sum(F.size("__drop"))).first()
    if n_drops + (n_hashes or 0) <= BROADCAST_ROWS:  # else the texts are shuffled by id
        drops = F.broadcast(drops)
    kept = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    split = F.split(F.col(text_col).cast("string"), "\n")
    rest = F.filter("__lines", lambda x: ~F.array_contains("__drop", F.xxhash64(masked(x))))
    own = docs.select(*kept).join(drops, F.col(id_col) == F.col("__id"), "left")
    cut = own.withColumn("__lines", split).withColumn("__rest", F.when(F.col("__drop").isNotNull(), rest))
    text = F.when(F.col("__rest").isNotNull(), F.array_join("__rest", "\n")).otherwise(F.col(text_col))
    n_lines = F.when(F.col(text_col).isNull(), 0).otherwise(F.size("__lines"))
    dropped = F.when(F.col("__rest").isNotNull(), F.size("__lines") - F.size("__rest")).otherwise(0)
    return cut.select(
        *[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in kept],
        n_lines.cast("long").alias("n_lines"),
        dropped.cast("long").alias("n_dropped"),
    )
