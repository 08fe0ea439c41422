"""Line deduplication by a segment-partition edit join."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions.lineage import cut, written
from attesta.llm.common import broadcast_if_small, let, unused
from attesta.llm.components import components

#: Lines within this edit distance are copies of each other; with one edit a line has two segments.
EDITS = 1
#: Shorter lines (in normalized characters) are never removed.
MIN_CHARS = 20
#: Groups of more lines than this are linked through deletion keys instead of pairs.
CROWD = 32
BLOCKS = 8


def normalized(line: Column) -> Column:
    """Lower case, runs of blanks as one, ends trimmed."""
    low = F.lower(line)
    return F.trim(F.when((F.instr(low, "  ") > 0) | (F.instr(low, "\t") > 0) | (F.instr(low, "\r") > 0), F.regexp_replace(low, r"[ \t\r]+", " ")).otherwise(low))


def _occurrences(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, h, line_no, line) of the lines that can be removed; h tells rows with equal keys apart."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    lines = F.transform(F.split("text", "\n", -1), normalized)
    return rows.select("doc_id", F.xxhash64("text").alias("h"), F.posexplode(lines).alias("line_no", "line")).where(F.length("line") >= MIN_CHARS)


def _id() -> Column:
    return F.unhex(F.md5(F.col("line").cast("binary"))).alias("id")


def _segment(line: Column, length: Column, no: int, shift: Column | int = 0) -> Column:
    """Hash of the first or second half that a line of `length` characters has, read from `line` at `shift`."""
    half = (length / 2).cast("int")
    part = F.substring(line, F.lit(1), half) if no == 0 else F.substring(line, half + 1 + shift, length - half)
    return F.xxhash64(F.lit(no), length, part)


def segment_keys(line: Column) -> dict[str, Column]:
    """own0, own1: both segments of a line; probe0, probe1: where the segments of a line one character shorter can lie."""
    n = F.length(line)
    return {"own0": _segment(line, n, 0), "own1": _segment(line, n, 1), "probe0": _segment(line, n - 1, 0), "probe1": _segment(line, n - 1, 1, 1)}


def _blocks(line: Column, length: Column, shift: int) -> Column:
    """Eight one-byte hashes of the blocks of a line of `length` characters, as one long, first block on top."""
    out = F.lit(0).cast("long")
    for b in range(BLOCKS):
        start, end = (length * b / BLOCKS).cast("int"), (length * (b + 1) / BLOCKS).cast("int")
        one = F.xxhash64(F.substring(line, start + 1 + shift, end - start)).bitwiseAND(F.lit(255))
        out = F.shiftleft(out, 8).bitwiseOR(one)
    return out


def _common(a: Column, b: Column, part: Callable[[Column, Column], Column]) -> Column:
    """Length of the longest common prefix or suffix, by bisection over its bits."""
    most = F.least(F.length(a), F.length(b))

    def longer(got: Column, bit: Column) -> Column:
        return let(got + F.call_function("shiftleft", F.lit(1), bit), lambda n: F.when((n <= most) & (part(a, n) == part(b, n)), n).otherwise(got))

    top = F.ceil(F.log2(most + 1)).cast("int")
    return F.aggregate(F.sequence(top, F.lit(0), F.lit(-1)), F.lit(0), longer)


def banded_distance(a: Column, b: Column, k: int) -> Column:
    """Edit distance of two arrays of characters if it is k at most, else more than k; a is not the longer one.

    Bit-parallel columns (Myers 1999) in a band of 2k+1 diagonals (Hyyrö 2003): bit t of column j stands for row
    j-k+t. The band's lowest diagonal carries the distance until it meets the last row, then that row carries it.
    """
    m, n = F.size(a), F.size(b)
    wide = 2 * k + 1
    mask = F.lit((1 << wide) - 1).cast("long")
    inverse = lambda x: F.bitwise_not(x).bitwiseAND(mask)
    right = lambda x, by: F.call_function("shiftrightunsigned", x, by)

    def step(s: Column, j: Column) -> Column:
        vp, vn = s["vp"], s["vn"]
        equal = F.lit(0).cast("long")
        for t in range(wide):
            row = j - k + t
            equal = equal.bitwiseOR(F.when((row >= 1) & (row <= m) & (F.get(a, row - 1) == F.get(b, j - 1)), F.lit(1 << t).cast("long")).otherwise(F.lit(0).cast("long")))
        return let(equal, lambda x: F.struct(vp.alias("vp"), vn.alias("vn"), (x.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(x).bitwiseOR(vn).bitwiseAND(mask).alias("d0")))

    def advance(s: Column, j: Column) -> Column:
        def from_d0(x: Column) -> Column:
            d0, vp, vn = x["d0"], x["vp"], x["vn"]
            hp, hn = vn.bitwiseOR(inverse(d0.bitwiseOR(vp))), d0.bitwiseAND(vp)
            last = F.greatest(m - j + k, F.lit(0))
            change = F.when(j + k <= m, F.when(right(d0, F.lit(2 * k)) == 0, 1).otherwise(0)).otherwise(
                (right(hp, last).bitwiseAND(F.lit(1).cast("long")) - right(hn, last).bitwiseAND(F.lit(1).cast("long"))).cast("int")
            )
            down = right(d0, F.lit(1))
            return F.struct(hn.bitwiseOR(inverse(down.bitwiseOR(hp))).alias("vp"), down.bitwiseAND(hp).alias("vn"), (s["d"] + change).alias("d"))

        return let(step(s, j), from_d0)

    start = F.struct(F.lit(((1 << (k + 1)) - 1) << k).cast("long").alias("vp"), F.lit(0).cast("long").alias("vn"), F.least(m, F.lit(k)).alias("d"))
    folded = F.aggregate(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), start, advance)["d"]
    return F.when(n - m > k, F.lit(k + 1)).when(m == 0, n).otherwise(folded)


def within(a: Column, b: Column, k: int) -> Column:
    """Whether two strings are k edits apart at most; equal ends are stripped before the columns are run."""
    chars = lambda x, end: F.when(F.length(x) > end, F.split(F.left(x, F.length(x) - end), "")).otherwise(F.array().cast("array<string>"))
    tail = lambda x, n: F.right(x, n)
    head = lambda x, n: F.left(x, n)
    pair = lambda x, y: F.struct(x.alias("s"), y.alias("t"))
    first = F.length(a) <= F.length(b)
    ordered = pair(F.when(first, a).otherwise(b), F.when(first, b).otherwise(a))
    return let(
        ordered,
        lambda o: let(
            _common(o["s"], o["t"], head),
            lambda p: let(
                pair(F.substring(o["s"], p + 1, F.length(o["s"])), F.substring(o["t"], p + 1, F.length(o["t"]))),
                lambda r: let(
                    _common(r["s"], r["t"], tail),
                    lambda q: let(pair(chars(r["s"], q), chars(r["t"], q)), lambda c: banded_distance(c["s"], c["t"], k) <= k),
                ),
            ),
        ),
    )


def verified(pairs: DataFrame, k: int = EDITS) -> DataFrame:
    """(a, b) of the rows (a, b, line_a, line_b) whose lines are within k edits."""
    return pairs.where(within(F.col("line_a"), F.col("line_b"), k)).select("a", "b")


def _deletion_keys(texts: DataFrame) -> DataFrame:
    """(key, id, whole): keys under which all lines at one edit meet, in blocks of about the root of the length.

    A line gives one key for each deleted character: with the place, shared by lines that differ by another character
    there, and without it, shared with the line that is the rest. That line gives `whole` keys, one for each block.
    """
    side = lambda n: F.ceil(F.sqrt(n)).cast("int")

    def parts(n: Column, drop: int) -> DataFrame:
        s = texts.select("id", "line", n.alias("n"), F.explode(F.sequence(F.lit(0), F.ceil(n / side(n)).cast("int") - 1)).alias("b"))
        s = s.select("id", "line", "n", "b", (F.col("b") * side(F.col("n"))).alias("at"), F.least(side(F.col("n")), F.col("n") - F.col("b") * side(F.col("n"))).alias("size"))
        return s.select(
            "id", "n", "b", "size", F.xxhash64(F.expr("left(line, at)")).alias("before"), F.expr(f"substring(line, at + 1, size - {drop})").alias("chunk"), F.xxhash64(F.expr(f"substring(line, at + 1 + size - {drop})")).alias("after")
        )

    less = parts(F.length("line"), 0).select("*", F.explode(F.expr("sequence(1, size)")).alias("p"))
    less = less.withColumn("chunk", F.expr("concat(left(chunk, p - 1), substring(chunk, p + 1))"))
    same = less.select(F.xxhash64("n", "b", "p", "before", "after", "chunk").alias("key"), "id", F.lit(False).alias("whole"), F.lit(True).alias("placed"))
    free = less.select(F.xxhash64("n", "b", "before", "after", "chunk").alias("key"), "id", F.lit(False).alias("whole"), F.lit(False).alias("placed")).distinct()
    rest = parts(F.length("line") + 1, 1).select(F.xxhash64("n", "b", "before", "after", "chunk").alias("key"), "id", F.lit(True).alias("whole"), F.lit(False).alias("placed"))
    return same.unionByName(free).unionByName(rest)


def _crowd_links(texts: DataFrame) -> DataFrame:
    """(a, b): for every deletion key one hub, so that the links grow with the lines and not with their pairs."""
    keys = _deletion_keys(texts)
    hubs = keys.groupBy("key", "placed").agg(
        F.min(F.hex("id")).alias("least"), F.min(F.when(F.col("whole"), F.hex("id"))).alias("rest"), F.count("*").alias("n")
    ).where("n > 1 and (placed or rest is not null)").select("key", "placed", F.unhex(F.coalesce("rest", "least")).alias("a"))
    return keys.join(hubs, ["key", "placed"]).select("a", F.col("id").alias("b")).where("a <> b").distinct()


def line_links(docs: DataFrame, lines: DataFrame, key: str, text: str) -> DataFrame:
    """(a, b): links between the ids of different lines that connect all lines at one edit or less."""
    rows = lines.select(
        "id", F.inline(F.array(*[F.struct(F.col(c).alias("key"), F.lit(i).cast("int").alias("probe")) for c, i in (("own0", 0), ("own1", 0), ("probe0", 1), ("probe1", 1))]))
    )
    hashed = F.xxhash64("id")
    live = rows.groupBy("key").agg(F.min(hashed).alias("lo"), F.max(hashed).alias("hi"), F.min("probe").alias("p"), F.count("*").alias("n")).where("lo <> hi and p = 0").select("key", "n")
    live = cut(rows.join(broadcast_if_small(cut(live)), "key"))
    wanted = cut(live.select("id").distinct().join(lines.select("id", "first"), "id"))
    holders = broadcast_if_small(wanted.select("first.doc_id", "first.h").distinct())
    held = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    held = held.join(holders, held["doc_id"].eqNullSafe(holders["doc_id"]) & (held["h"] == holders["h"]), "left_semi")
    # Repeats of a line are equal, whichever comes first.
    texts = cut(_occurrences(held, "doc_id", "text").select(_id(), "line").join(broadcast_if_small(wanted.select("id")), "id").dropDuplicates(["id"]))

    n = F.length("line")
    own = texts.select("id", _blocks(F.col("line"), n, 0).alias("own"), _blocks(F.col("line"), n - 1, 0).alias("left"), _blocks(F.col("line"), n - 1, 1).alias("right"))
    few = live.where(F.col("n") <= CROWD).join(own, "id")
    index = few.where("probe = 0").select("key", F.col("id").alias("a"), F.col("own").alias("x"))
    probe = few.select("key", F.col("id").alias("b"), "probe", F.when(F.col("probe") == 0, F.col("own")).otherwise(F.col("left")).alias("l"), F.when(F.col("probe") == 0, F.col("own")).otherwise(F.col("right")).alias("r"))
    met = index.join(probe, "key").where("a <> b and (probe = 1 or a < b)")
    # One edit touches one block: the blocks before it agree from the left, those after it from the right.
    from_left = sum(((F.shiftrightunsigned(F.col("x").bitwiseXOR(F.col("l")), 8 * i) == 0).cast("int") for i in range(BLOCKS)), F.lit(0))
    from_right = sum(((F.shiftleft(F.col("x").bitwiseXOR(F.col("r")), 8 * i) == 0).cast("int") for i in range(BLOCKS)), F.lit(0))
    pairs = met.where(from_left + from_right >= BLOCKS - EDITS).select("a", "b").distinct()

    crowd = live.where(F.col("n") > CROWD).select("id").distinct().join(texts, "id")
    candidates = pairs.unionByName(_crowd_links(crowd))
    lined = candidates.join(texts.select(F.col("id").alias("a"), F.col("line").alias("line_a")), "a").join(texts.select(F.col("id").alias("b"), F.col("line").alias("line_b")), "b")
    return verified(lined)


def repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, h, line_no, first_doc, first_h, first_line): every line that is a copy of an earlier one, with the one that stays.

    Copies are lines of MIN_CHARS normalized characters or more that are equal or linked by steps of at most EDITS
    edits; of each class the line first in (key, hash of the text, line number) stays. h is xxhash64 of the row's text.

    Halves of every different line and of the lines it could come from by one edit meet on a hash. Where few lines meet,
    pairs are compared by the hashes of eight blocks and then verified; where many meet, every line is linked to one hub
    under keys with one character deleted. Texts are read only of lines that meet others.
    """
    # A table: keys and hashes of a row repeat with its lines, and only four columns are read again below.
    found = written(
        _occurrences(docs, key, text).select("doc_id", "h", "line_no", _id(), *[c.alias(n) for n, c in segment_keys(F.col("line")).items()]), "lines"
    )
    lines = cut(
        found.groupBy("id").agg(F.min(F.struct("doc_id", "h", "line_no")).alias("first"), F.count("*").alias("n"), *[F.min(c).alias(c) for c in ("own0", "own1", "probe0", "probe1")])
    )
    roots = cut(components(line_links(docs, lines, key, text)))
    linked = roots.join(lines.select("id", "first"), "id")
    stays = linked.groupBy("root").agg(F.min("first").alias("keep"))
    classes = linked.join(stays, "root").select("id", "keep").unionByName(
        lines.where("n > 1").join(roots, "id", "left_anti").select("id", F.col("first").alias("keep"))
    )
    again = found.select("doc_id", "h", "line_no", "id").join(broadcast_if_small(cut(classes)), "id")
    return again.where(~F.struct("doc_id", "h", "line_no").eqNullSafe(F.col("keep"))).select(
        "doc_id", "h", "line_no", F.col("keep.doc_id").alias("first_doc"), F.col("keep.h").alias("first_h"), F.col("keep.line_no").alias("first_line")
    )


def whole_copies(docs: DataFrame, gone: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, h) of the rows that lose lines and hold nothing else: every other line is blank, or is short and a copy too.

    `gone` is what `repeated_lines` found. A short line is a copy if a text that keeps a line removed here has it,
    normalized; such a text keeps a long line, so it stays itself.
    """
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["h"] == b["h"])
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    lost = gone.groupBy("doc_id", "h").agg(F.collect_set("line_no").alias("nos"), F.collect_set(F.struct("first_doc", "first_h")).alias("keepers"))
    all_lines = F.transform(F.split("text", "\n", -1), normalized)
    left = F.filter(F.transform("all", lambda x, i: F.when(~F.array_contains("nos", i), x)), lambda x: F.length(x) > 0)
    digests = lambda x: F.array_distinct(F.transform(x, lambda y: F.unhex(F.md5(y.cast("binary")))))
    short = rows.join(lost.withColumnRenamed("doc_id", "d").withColumnRenamed("h", "g"), rows["doc_id"].eqNullSafe(F.col("d")) & (rows["h"] == F.col("g")))
    short = short.select("doc_id", "h", "keepers", "nos", all_lines.alias("all")).select("doc_id", "h", "keepers", left.alias("left"))
    short = short.where(~F.exists("left", lambda x: F.length(x) >= MIN_CHARS))
    short = cut(short.select("doc_id", "h", "keepers", digests(F.col("left")).alias("need")).dropDuplicates(["doc_id", "h"]))

    asked = cut(short.where(F.size("need") > 0).select(F.explode("keepers").alias("k")).select(F.col("k.first_doc").alias("doc_id"), F.col("k.first_h").alias("h")).distinct())
    asked = broadcast_if_small(asked)
    has = rows.join(asked, same(rows, asked), "left_semi").select("doc_id", "h", all_lines.alias("all"))
    has = has.select("doc_id", "h", F.explode(digests(F.filter("all", lambda x: (F.length(x) > 0) & (F.length(x) < MIN_CHARS)))).alias("s")).distinct()
    has = has.select(F.xxhash64("doc_id", "h", "s").alias("at"), F.col("doc_id").alias("first_doc"), F.col("h").alias("first_h"), F.col("s").alias("t"))
    need = short.select("doc_id", "h", F.explode("keepers").alias("k"), "need").select("doc_id", "h", "k", F.explode("need").alias("s"))
    need = need.withColumn("at", F.xxhash64("k.first_doc", "k.first_h", "s"))
    met = need.join(has, "at").where(F.col("k.first_doc").eqNullSafe(F.col("first_doc")) & (F.col("k.first_h") == F.col("first_h")) & (F.col("s") == F.col("t")))
    met = met.select("doc_id", "h", "s").distinct().groupBy(F.col("doc_id").alias("d"), F.col("h").alias("g")).agg(F.count("*").alias("n"))
    found = short.join(met, short["doc_id"].eqNullSafe(met["d"]) & (short["h"] == met["g"]), "left")
    return found.where(F.size("need") == F.coalesce("n", F.lit(0))).select("doc_id", "h")


def deduplicate_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", into: str = "removed", found: DataFrame | None = None) -> DataFrame:
    """`docs` with copied lines taken out of the text, and the struct array `into` of (line_no, first_doc, first_line).

    A column that is called `into` already is replaced. Other columns and rows stay as they are; lines that remain keep their order and form. A text whose lines are all
    copies becomes empty, a null text stays null, an empty one empty. Rows that repeat both key and text get the same
    result as one another. An empty table gives an empty one. `found` is what `repeated_lines` gave for `docs`, if a
    caller has it already.
    """
    docs = docs.drop(into)
    k, h, split, at = unused(docs, "key_of_line", "hash_of_text", "lines_of_text", "places_that_stay")
    found = repeated_lines(docs, key, text) if found is None else found
    gone = found.select("doc_id", "h", "line_no", "first_doc", "first_line").distinct().groupBy(F.col("doc_id").alias(k), F.col("h").alias(h)).agg(
        F.sort_array(F.collect_list(F.struct("line_no", "first_doc", "first_line"))).alias(into)
    )
    typed = docs.withColumn(h, F.xxhash64(F.col(text).cast("string")))
    joined = typed.join(gone, typed[key].eqNullSafe(gone[k]) & (typed[h] == gone[h]), "left").drop(gone[h]).drop(k, h)
    laid = joined.withColumn(split, F.when(F.col(into).isNotNull(), F.split(text, "\n", -1)))
    laid = laid.withColumn(at, F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col(f"{into}.line_no")))
    kept = F.array_join(F.transform(F.col(at), lambda i: F.get(F.col(split), i)), "\n")
    return laid.withColumn(text, F.when(F.col(into).isNull(), F.col(text)).otherwise(kept)).withColumn(
        into, F.coalesce(F.col(into), F.array().cast(gone.schema[into].dataType))
    ).drop(split, at)
