"""Line deduplication through a log-template tree.

A line is parsed by the tree's fixed depth: token count, then the first ``depth`` tokens (a token with a digit is a
variable field already, ``<*>``). Lines that reach one leaf share a shape. A leaf's template holds, place by place, the
token that stands there in more than half of the leaf's different lines; any other place is a variable field. A line
takes the template if ``similarity`` of its tokens at least are the template's. Where lines of a leaf take no template, the
leaf mixes several: those lines are split by their token at the place with the fewest different tokens (the first such
place), and each part has a template of its own, ``splits`` times at most. A line that takes none is its own template.

All shares are relative to the leaf, so a template collapses alike in small and large data, whatever number of
fields it has. No two lines are compared with each other: every step is a grouped aggregate with map-side combine, and the
result depends on no order of arrival.

Lines of fewer than ``min_tokens`` tokens do not generalise: their own masked text is their template. Where the mask
leaves no letter the template is the text itself, so that different numbers stay apart; of such lines those of
``MIN_CHARS`` characters or more (scripts without spaces) have just their digits masked. Blank lines are never templates.

A template recurs if it occurs in two documents or more. Its lines stay in the first of them (smallest id, then text
hash) and are dropped from all others. A line, template or token that holds a large share of all rows meets the others by a
broadcast of such hot keys (fewer than a fixed number), not in one task.

Rows of equal id and text are one document. Defined results: null text stays null, empty text stays empty, both without
dropped lines; a null id sorts before all others; a very long text is parsed line by line in its task, and its drops are one
array of positions; a column that a name in ``counts`` clashes with gives way to the count; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import HOT_SHARE, Scratch, bitmap, materialise, probe_bitmap, spread_join

FILTER_BITS = 1 << 24
VARIABLE = "<*>"
MIN_CHARS = 20
#: A part of the tree is judged in one row if it has at most a thousandth of all lines, within these bounds.
FEW, MANY = 32, 4096
#: Lines of a larger part whose tokens are counted in one row before the counts meet.
BLOCK = 256
_SPACES = " \t\r\x0b\f"


def _normalised(raw: Column) -> Column:
    """Tokens apart by single spaces, those with a digit masked. Most lines need neither; two looks at a line find that out."""
    spaced = F.trim(F.regexp_replace(raw, r"\s+", " "))
    plain = raw.rlike(r"\A[^0-9\t\r\x0b\f]*+\z") & ~F.contains(raw, F.lit("  "))
    return F.when(plain, F.trim(raw)).otherwise(F.regexp_replace(spaced, r"\S*[0-9]\S*", VARIABLE))


def _document(id_col: str, text_col: str) -> Column:
    return F.struct(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("h"))


def _short(raw: Column, text: Column) -> Column:
    """The template of a short line: its masked text, or what it says where the mask leaves no letter."""
    exact = F.trim(F.regexp_replace(raw, r"\s+", " "))
    own = F.when(exact.rlike(r"\p{L}") & (F.length(exact) >= MIN_CHARS), F.regexp_replace(exact, "[0-9]+", VARIABLE)).otherwise(exact)
    return F.when(text.rlike(r"\p{L}"), text).otherwise(own)


def _lines(docs: DataFrame, depth: int, min_tokens: int, id_col: str, text_col: str) -> DataFrame:
    """(doc, pos, text, leaf, line, n): leaf and line are 64-bit hashes, used together; n is null for short lines."""
    rows = docs.select(_document(id_col, text_col).alias("doc"), F.posexplode(F.split(F.col(text_col).cast("string"), "\n")).alias("pos", "raw"))
    # asked of the raw line: a filter on the normalised one is pushed below it and normalises every line twice
    rows = rows.where(F.ltrim("raw", F.lit(_SPACES)) != "").select("doc", "pos", "raw", _normalised(F.col("raw")).alias("text"))
    rows = rows.withColumn("n", F.octet_length("text") - F.octet_length(F.replace("text", F.lit(" "), F.lit(""))) + 1)
    long = F.col("n") >= min_tokens
    rows = rows.withColumn("text", F.when(long, F.col("text")).otherwise(_short(F.col("raw"), F.col("text"))))
    leaf = F.xxhash64("n", F.substring_index("text", " ", depth))
    return rows.select("doc", "pos", "text", leaf.alias("leaf"), F.xxhash64("text").alias("line"), F.when(long, F.col("n")).alias("n"))


def _bit(*columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(FILTER_BITS))


def _columns(lists: str) -> Column:
    """The tokens of each place, sorted, of token lists of one length."""
    ats = F.sequence(F.lit(0), F.size(F.get(lists, F.lit(0))) - 1)
    return F.transform(ats, lambda at: F.sort_array(F.transform(lists, lambda x: F.get(x, at))))


def _judge_large(lines: DataFrame, scratch: Scratch) -> DataFrame:
    """``lines`` (with the size of their part) with constants and cut of their part, however many lines it has.

    Blocks of lines count their tokens place by place; a row for each different token of a block's place goes on.
    """
    block = F.pmod(F.col("line"), F.ceil(F.col("size") / BLOCK)).alias("block")
    blocks = lines.select("part", block, "tokens").groupBy("part", "block").agg(F.collect_list("tokens").alias("lists")).select("part", _columns("lists").alias("columns"))

    def counts(tokens: Column, at: Column) -> Column:
        kinds = F.array_distinct(tokens)  # in order, as the tokens are: each ends where the next begins
        upto = lambda k: F.coalesce(F.array_position(tokens, F.get(kinds, k)), F.size(tokens) + 1)
        return F.transform(kinds, lambda x, k: F.struct(at.alias("at"), x.alias("token"), (upto(k + 1) - upto(k)).alias("seen")))

    seen = blocks.select("part", F.inline(F.flatten(F.transform("columns", counts)))).groupBy("part", "at", "token").agg(F.sum("seen").alias("seen"))
    # numbers only, so that they are hashed and not sorted; of a tie no token has a majority
    places = seen.groupBy("part", "at").agg(F.max("seen").alias("most"), F.max_by("token", "seen").alias("token"), F.count(F.lit(1)).alias("kinds"), F.sum("seen").alias("held"))
    constant = F.when(2 * F.col("most") > F.col("held"), F.col("token")).alias("constant")
    by_place = F.sort_array(F.collect_list(F.struct("at", constant))).alias("places")
    cut = F.min(F.when(F.col("kinds") > 1, F.struct("kinds", "at"))).alias("cut")
    templates = places.groupBy("part").agg(F.max("held").alias("size"), by_place, cut).select("part", "size", F.col("places.constant").alias("constants"), F.col("cut.at").alias("cut"))
    return spread_join(lines.drop("size"), scratch.table(templates, "templates"), ["part"], "size")


def _judge_small(lines: DataFrame) -> DataFrame:
    """The same for parts of few lines, each of them in one row: the sorted tokens of a place have a majority's token in the middle."""
    parts = lines.groupBy("part").agg(F.collect_list(F.struct(*[c for c in lines.columns if c != "part"])).alias("rows"))
    parts = parts.select("part", "rows", F.size("rows").cast("long").alias("size"))

    def place(tokens: Column) -> Column:
        middle = F.get(tokens, F.floor(F.size(tokens) / 2).cast("int"))
        constant = F.when(2 * F.size(F.filter(tokens, lambda x: x == middle)) > F.size(tokens), middle)
        return F.struct(constant.alias("constant"), F.size(F.array_distinct(tokens)).alias("kinds"))

    parts = parts.withColumn("places", F.when(F.col("size") > 1, F.transform(_columns("rows.tokens"), place)))
    mixed = F.filter(F.transform("places", lambda p, at: F.struct(p.kinds.alias("kinds"), at.alias("at"))), lambda x: x.kinds > 1)
    parts = parts.select("part", "rows", "size", F.col("places.constant").alias("constants"), F.array_min(mixed)["at"].alias("cut"))
    return parts.select("part", "size", "constants", "cut", F.inline("rows"))


def generalise(near: DataFrame, *, similarity: float, splits: int, scratch: Scratch) -> DataFrame:
    """``near``, different lines with their token hashes, with the template of their leaf or of a part of it that they take, or null."""
    names = [c for c in near.columns if c != "tokens"]
    lines, found = near.withColumn("part", F.col("leaf")), []
    for k in range(splits + 1):
        sizes = scratch.table(lines.groupBy("part").agg(F.count(F.lit(1)).alias("size")), "sizes")
        total, most = sizes.agg(F.sum("size"), F.max("size")).first()
        bound = max(FEW, min(MANY, (total or 0) // HOT_SHARE))
        if (most or 0) <= bound:
            met = _judge_small(lines)
        else:
            large = F.broadcast(sizes.where(F.col("size") > bound))
            own = scratch.table(lines.join(large, "part"), "large")
            met = _judge_small(lines.join(large, "part", "left_anti")).unionByName(_judge_large(own, scratch))
        agrees = F.size(F.filter(F.zip_with("tokens", "constants", lambda x, c: F.coalesce(x == c, F.lit(False))), lambda x: x))
        takes = (F.col("size") > 1) & (agrees >= F.size("tokens") * similarity)
        judged = scratch.table(met.select(*names, "tokens", "part", "size", F.get("tokens", "cut").alias("at_cut"), takes.alias("takes")), "judged")
        goes_on = ~F.col("takes") & (F.col("size") > 1) if k < splits else F.lit(False)
        found.append(judged.where(~goes_on).select(*names, F.when(F.col("takes"), F.col("part")).alias("template")))
        lines = judged.where(goes_on).select(*names, "tokens", F.xxhash64("part", "at_cut").alias("part"))
    return reduce(DataFrame.unionByName, found)


def find_repeats(docs: DataFrame, *, depth: int = 3, min_tokens: int = 5, similarity: float = 0.8, splits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, drops): documents with the positions of their lines to drop."""
    with Scratch(docs.sparkSession, "lines") as scratch:
        found = scratch.table(_lines(docs, depth, min_tokens, id_col, text_col), "found")
        held = [F.min("doc").alias("first"), F.max("doc").alias("last"), F.count(F.lit(1)).alias("held")]
        distinct = scratch.table(found.groupBy("leaf", "line", "n").agg(*held), "different")
        shared = distinct.where("n is not null").groupBy("leaf").agg(F.count(F.lit(1)).alias("lines")).where("lines > 1")
        shared = scratch.table(bitmap(shared, _bit("leaf")), "leaves")
        # lines alone in their leaf that the bitmap lets through are parts of one line: they take no template
        near = probe_bitmap(found.where("n is not null").select("doc", "leaf", "line", "text"), _bit("leaf"), shared).where("in_bitmap")
        near = near.groupBy("leaf", "line").agg(*held, F.first("text").alias("text"))
        near = near.select("leaf", "line", "first", "last", "held", F.transform(F.split("text", " "), lambda x: F.xxhash64(x)).alias("tokens"))
        general = generalise(scratch.table(near, "near"), similarity=similarity, splits=splits, scratch=scratch)
        alone = probe_bitmap(distinct.where("first != last"), _bit("leaf"), shared).where("n is null or not in_bitmap")
        named = general.unionByName(alone.select("leaf", "line", "first", "last", "held", F.lit(None).cast("long").alias("template")))
        # a line that is its own template and stands in one document does not recur
        named = named.where("template is not null or first != last").withColumn("general", F.col("template").isNotNull())
        named = scratch.table(named.withColumn("template", F.coalesce("template", "line")), "named")
        key = ["leaf", "template", "general"]
        recurring = named.groupBy(*key).agg(F.min("first").alias("keeper"), F.max("last").alias("other"), F.count(F.lit(1)).alias("lines")).where("keeper != other")
        recurring = scratch.table(recurring.drop("other"), "recurring")
        keepers = spread_join(named.select(*key, "line", "first", "last", "held"), recurring, key, "lines").where("first != keeper or last != keeper")
        keepers = scratch.table(keepers.select("leaf", "line", "keeper", "held"), "keepers")
        able = probe_bitmap(found.select("doc", "pos", "leaf", "line"), _bit("leaf", "line"), bitmap(keepers, _bit("leaf", "line"))).where("in_bitmap")
        repeated = spread_join(able.drop("in_bitmap"), keepers, ["leaf", "line"], "held").where("doc != keeper")
        return materialise(repeated.groupBy("doc").agg(F.sort_array(F.collect_set("pos")).alias("drops")), "drops")


def drop_repeated_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", counts: tuple[str, str] | None = None, **options) -> DataFrame:
    """``docs`` with texts less their repeated lines; ``counts`` names columns for lines and dropped lines.

    Only documents that a bitmap of fixed size lets through are shuffled to meet their drops.
    """
    names = [c for c in docs.columns if c not in (counts or ())]
    drops = find_repeats(docs, id_col=id_col, text_col=text_col, **options)
    row = F.struct(*[F.col(f"`{c}`") for c in names])
    rows = docs.select(row.alias("row"), _document(id_col, text_col).alias("doc"))
    probed = probe_bitmap(rows, _bit("doc"), bitmap(drops, _bit("doc")))
    touched = probed.where("in_bitmap").join(drops, "doc", "left").select("row", "drops")
    alone = probed.where(~F.col("in_bitmap")).select("row", F.lit(None).cast("array<int>").alias("drops"))
    all_ = touched.unionByName(alone)
    text = F.col("row").getField(text_col).cast("string")
    # a column of its own, read more than once: the lambda below must not split the text for every line
    parts = all_.select("row", "drops", F.when(F.col("drops").isNotNull(), F.split(text, "\n")).alias("parts"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), "drops")
    left = F.array_join(F.transform(stay, lambda i: F.get("parts", i)), "\n")
    out = [F.when(F.col("drops").isNotNull(), left).otherwise(text).alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in names]
    if counts:
        n_lines = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
        out += [F.coalesce(n_lines, F.lit(0)).alias(counts[0]), F.coalesce(F.size("drops"), F.lit(0)).alias(counts[1])]
    return parts.select(*out)
