"""Line dedup by a log-template tree of fixed depth, all in DataFrame operations.

A line (between line feeds, outer white space off) is parsed down a tree: first by its count of tokens, then by its leading tokens. Tokens
with a digit or an at sign are variable fields from the start. At each of the first ``depth`` levels a token keeps a branch of its own if
lines of at least ``least`` different texts take it there, else it goes down the branch of variable fields; a line with more than a third of these
levels variable isn't parsed on. In a leaf, the later tokens are compared in ``SEGMENTS`` runs (single tokens in lines short enough): a run is
constant if lines of so many texts have it there, and a variable field if not. What a line then reads is its template;
it needs constants for half of its tokens at least, and three of them if a field was found variable by comparison only.

A template recurs if it stands in at least ``least`` different texts (equal texts count once, a document's own repetitions don't count)
and in as many different surroundings, and no surrounding holds more than half of its texts: a line inside near-copies of one document
keeps its neighbours and doesn't count as recurring by that. A surrounding is the pair of leaves (count and leading tokens) of the
next lines on both sides, past blank lines and past lines already known to recur; so in rounds, until no more recur, a
fixed block is found from its outer lines on. Lines of recurring templates are dropped wherever they stand, whatever their length.

Only keys of at most eight bytes and counts summed before the shuffle travel, apart from the lines of leaves that could recur. Frequent
branches, constants and templates are broadcast if their rows are few, and else joined with the heaviest keys apart (``shared.heavy_join``).

Defined cases: null text stays null with 0 lines; empty text has one empty line, which stays, as all blank lines do; very long lines are
taken whole; of repeated rows, each gets the same result and together they count once; a document of recurring lines only
becomes empty; extra columns are kept.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import heavy_join, release, stage, unused

LEAST_TEXTS = 10
DEPTH, SEGMENTS = 5, 8
#: Constant tokens without which a template has no variable fields but those with a digit or an at sign.
LEAST_CONSTANTS = 3
#: Leading tokens that tell a neighbour.
AROUND = 3
VARIABLE = "<*>"

_OTHER_SPACE = r"[\x09\x0B-\x0D]"
_FIELD = r"(?<![^\x20\n])[^\x20\n0-9@]*+[0-9@][^\x20\n]*+"


def _clean(text: Column) -> Column:
    """Lines with variable fields masked and one space between tokens, none outside; no token becomes a value of its own."""
    other = reduce(Column.__or__, (F.contains(text, F.lit(c)) for c in "\t\x0b\x0c\r"))
    lines = F.split(F.when(other, F.regexp_replace(text, _OTHER_SPACE, " ")).otherwise(text), "\n", -1)
    masked = F.transform(lines, lambda line: F.when(line.rlike("[0-9@]"), F.regexp_replace(line, _FIELD, VARIABLE)).otherwise(line))
    single = F.transform(masked, lambda line: F.when(F.contains(line, F.lit("  ")), F.regexp_replace(line, "  +", " ")).otherwise(line))
    return F.transform(single, lambda line: F.trim(line))


def _lined(docs: DataFrame, depth: int) -> DataFrame:
    """Rows (text_key, place, n, leaf, before, after, lead0.., tail) of every line that isn't blank: hashes of its first ``depth`` tokens, and the text after them.

    A leading token that is a variable field, or isn't there, is null, as is ``tail`` of a line without later tokens.
    ``before`` and ``after`` are place and leaf of the next lines that aren't blank, null at the text's edges.
    """
    text = F.col("text").cast("string")
    spaces = lambda line: F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit("")))
    full = F.transform(_clean(text), lambda line, i: F.struct(i.alias("place"), line.alias("line"), (spaces(line) + 1).alias("n")))
    full = F.filter(full, lambda s: s["line"] != "")
    rows = docs.where("text is not null").select(F.xxhash64(text).alias("text_key"), full.alias("full"))
    leaf = lambda s: F.xxhash64(s["n"], F.substring_index(s["line"], " ", AROUND))
    rows = rows.select("text_key", "full", F.transform("full", lambda s: F.struct(s["place"].alias("place"), leaf(s).alias("leaf"))).alias("leaves"))
    at = lambda j: F.get("leaves", j)
    line = F.transform("full", lambda s, j: F.struct(s["place"].alias("place"), s["line"].alias("line"), s["n"].alias("n"), at(j)["leaf"].alias("leaf"), at(j - 1).alias("before"), at(j + 1).alias("after")))
    rows = rows.select("text_key", F.explode(line).alias("line")).select("text_key", "line.*")
    first = [F.substring_index(F.substring_index("line", " ", d + 1), " ", -1) for d in range(depth)]
    lead = [F.when((F.col("n") > d) & (token != VARIABLE), F.xxhash64(token)).alias(f"lead{d}") for d, token in enumerate(first)]
    tail = F.when(F.col("n") > depth, F.substr("line", F.char_length(F.substring_index("line", " ", depth)) + 2))
    return rows.select("text_key", "place", "n", "leaf", "before", "after", *lead, tail.alias("tail"))


def _in_texts(rows: DataFrame, key: str, least: int) -> DataFrame:
    """Keys (key, weight) that lines of at least so many different texts have."""
    return rows.select(key, "text_key").distinct().groupBy(key).agg(F.count("*").alias("weight")).where(F.col("weight") >= least)


def templates(lines: DataFrame, least: int = LEAST_TEXTS, depth: int = DEPTH) -> DataFrame:
    """Rows (text_key, place, key, leaf, before, after): the template of each line that has one and shares it with at least ``least`` texts."""
    around = ["leaf", "before", "after"]
    at = lines.withColumns({"node": F.xxhash64("n"), "wild": F.lit(0), "found": F.lit(0)})
    for d in range(depth):
        token = F.col(f"lead{d}")
        at = at.withColumn("branch", F.when(token.isNotNull(), F.xxhash64("node", token)))
        common = stage(_in_texts(at.where("branch is not null"), "branch", least).withColumn("known", F.lit(True)), "branches")
        at = heavy_join(at, common, "branch", "left")
        variable = (F.col("n") > d) & F.col("known").isNull()
        node = F.when(F.col("n") <= d, F.col("node")).when(variable, F.xxhash64("node", F.lit(VARIABLE))).otherwise(F.col("branch"))
        compared = (variable & F.col("branch").isNotNull()).cast("int")
        at = at.select("text_key", "place", *around, "n", *(f"lead{e}" for e in range(d + 1, depth)), "tail", node.alias("node"), (F.col("wild") + variable.cast("int")).alias("wild"), (F.col("found") + compared).alias("found"))
        at = at.where(F.col("wild") * 3 <= F.least("n", F.lit(depth)))
    leaves = stage(_in_texts(at, "node", least), "leaves")
    line = ["text_key", "place", "n", "node", "wild", "found"]
    # equal texts have equal lines
    live = stage(heavy_join(at, leaves, "node").select(*line, *around, "tail").dropDuplicates(["text_key", "place"]), "live")
    m = F.col("n") - depth
    parts = F.least(m, F.lit(SEGMENTS))
    edge = lambda j: F.floor(j * m / parts).cast("int")
    each = live.where(m > 0).select(*line, F.split("tail", " ", -1).alias("tail"), m.alias("m"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("i"))
    each = each.select(*line, "i", F.slice("tail", edge(F.col("i")) + 1, edge(F.col("i") + 1) - edge(F.col("i"))).alias("run"))
    each = each.select(*line, "i", F.xxhash64("node", "i", "run").alias("cell"), F.size("run").alias("size"), F.size(F.filter("run", lambda t: t == VARIABLE)).alias("fields"))
    constant = stage(_in_texts(each, "cell", least).withColumn("known", F.lit(True)), "constants")
    known = F.col("known").isNotNull()
    read = heavy_join(each, constant, "cell", "left").select(
        *line, "i", F.when(known, F.col("cell")).alias("cell"), F.when(known, F.col("fields")).otherwise(F.col("size")).alias("more"), (~known & (F.col("fields") < F.col("size"))).cast("int").alias("compared")
    )
    tails = read.groupBy(*line).agg(F.sort_array(F.collect_list(F.struct("i", "cell"))).alias("cells"), F.sum("more").alias("more"), F.sum("compared").alias("compared"))
    keyed = tails.select("text_key", "place", "n", F.xxhash64("node", F.col("cells.cell")).alias("key"), (F.col("wild") + F.col("more")).alias("wild"), (F.col("found") + F.col("compared")).alias("found"))
    short = live.where(m <= 0).select("text_key", "place", "n", F.col("node").alias("key"), "wild", "found")
    good = (F.col("wild") * 2 <= F.col("n")) & ((F.col("found") == 0) | (F.col("n") - F.col("wild") >= LEAST_CONSTANTS))
    found = stage(keyed.unionByName(short).where(good).select("text_key", "place", "key"), "templates")
    shared = heavy_join(found, _in_texts(found, "key", least), "key").select("text_key", "place", "key")
    out = stage(shared.join(live.select("text_key", "place", *around), ["text_key", "place"]), "shared")
    release(live, leaves, constant, found)
    return out


def recurring(found: DataFrame, least: int = LEAST_TEXTS) -> DataFrame:
    """Templates (key, weight) of ``templates`` that recur, weight being their lines; rounds go on as long as they find more.

    A round reads only lines whose template isn't decided, and the lines next to these. A template is decided once it recurs, or once the
    texts where no undecided line is next to its first line (their surroundings can't change any more) rule it out.
    """
    inside = Window.partitionBy("text_key").orderBy("place")

    def seen(rows: DataFrame) -> DataFrame:
        near = lambda f: F.coalesce(f("leaf").over(inside), F.lit(0))
        is_open = F.lag("key").over(inside).isNotNull() | F.lead("key").over(inside).isNotNull()
        marked = rows.select("text_key", "place", "leaf", "key", F.xxhash64(near(F.lag), near(F.lead)).alias("around"), is_open.alias("open"))
        return stage(marked.where("key is not null or open"), "open")

    here = F.struct("place", "leaf", "key")
    beside = [F.struct(F.col(c)["place"].alias("place"), F.col(c)["leaf"].alias("leaf"), F.lit(None).cast("bigint").alias("key")) for c in ("before", "after")]
    rows = found.select("text_key", F.explode(F.array(here, *beside)).alias("line")).select("text_key", "line.*").where("place is not null")
    rows = seen(rows.groupBy("text_key", "place").agg(F.max("leaf").alias("leaf"), F.max("key").alias("key")))
    hot = []
    while True:
        # one surrounding a text, the first
        texts = rows.where("key is not null").groupBy("key", "text_key").agg(F.min(F.struct("place", "around", "open")).alias("first"), F.count("*").alias("lines"))
        each = texts.groupBy("key", F.col("first.around").alias("around")).agg(F.count("*").alias("texts"), F.count_if("first.open").alias("open"), F.sum("lines").alias("lines"))
        fixed = F.col("texts") - F.col("open")
        sums = each.groupBy("key").agg(
            *(F.count("*").alias("n"), F.sum("texts").alias("texts"), F.max("texts").alias("most"), F.sum("lines").alias("weight")),
            *(F.sum("open").alias("open"), F.count_if(fixed > 0).alias("fixed"), F.max(fixed).alias("most_fixed")),
        )
        recurs = (F.col("n") >= least) & (F.col("most") * 2 <= F.col("texts"))
        may = (F.col("open") > 0) & (F.col("fixed") + F.col("open") >= least) & (F.col("most_fixed") * 2 <= F.col("texts"))
        decided = stage(sums.where(recurs | may).select("key", "weight", recurs.alias("recurs")), "recurring")
        hot.append(decided.where("recurs").select("key", "weight"))
        if hot[-1].isEmpty():
            release(rows)
            return reduce(DataFrame.unionByName, hot)
        left = heavy_join(rows, decided, "key", "left").where("recurs is null or not recurs")
        left = left.select("text_key", "place", "leaf", F.when(F.col("recurs").isNotNull(), F.col("key")).alias("key"))
        before, rows = rows, seen(left)
        release(before)


def drop_recurring_lines(docs: DataFrame, least: int = LEAST_TEXTS, depth: int = DEPTH) -> DataFrame:
    """``docs`` with the lines of recurring templates out of ``text``, plus ``n_lines`` and ``n_dropped``."""
    _key, _out = (unused(docs, c) for c in ("_key", "_out"))
    lines = stage(_lined(docs, depth), "lines")
    found = templates(lines, least, depth)
    out = heavy_join(found, recurring(found, least), "key").groupBy("text_key").agg(F.collect_set("place").alias(_out))
    text = F.col("text").cast("string")
    copies = docs.where("text is not null").groupBy(F.xxhash64(text).alias("text_key")).agg(F.count("*").alias("weight"))
    out = stage(out.join(copies, "text_key").select(F.col("text_key").alias(_key), _out, "weight"), "out")
    release(lines, found)
    rows = docs.withColumn(_key, F.xxhash64(text))
    joined = heavy_join(rows, out.select(_key, _out, F.col("weight").alias(unused(docs, "_weight"))), _key, "left", unused(docs, "_weight"))
    lines = F.split(text, "\n", -1)
    kept = F.when(F.col(_out).isNull(), text).otherwise(
        F.array_join(F.transform(F.filter(F.transform(lines, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: ~F.array_contains(F.col(_out), s["i"])), lambda s: s["x"]), "\n")
    )
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return joined.select(
        *(kept.alias("text") if c == "text" else F.col(c) for c in names),
        F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("bigint").alias("n_lines"),
        F.when(F.col(_out).isNull(), 0).otherwise(F.size(_out)).cast("bigint").alias("n_dropped"),
    )
