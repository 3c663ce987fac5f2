"""Removal of lines that repeat an earlier line, by an exact set-similarity join.

A line's set holds its distinct words, in lower case.  A line goes if an earlier one, by document id and line number, has
a set of Jaccard similarity ``threshold`` or more with it.

1. Equal lines are grouped by a 128-bit digest; their first place speaks for all.
2. A line's tokens are ordered by rarity.  Counts come from all lines; they are kept in a table of fixed size by
   hashed token, a constant of the plan, so any two lines order their tokens alike whatever shares a slot.
3. Prefix filter: two similar sets share one of the first n - ceil(t * n) + 1 tokens of each.  These tokens are joined
   with themselves, under the length filter and the positional filter, and under a bound on the sets' symmetric
   difference: each token flips one of 128 bits, so at least as many tokens differ as bits of the XOR are set.
4. Candidates are verified on the full sets of their lines; ``repeated_lines`` first rules out those that 256 bits tell.

``removed_lines`` counts every link.  Lines of large groups of near copies are not paired for that: each is described by
the words that it has more and less than the words of most lines of its group.  Two lines of a group share all of these
but what either lacks, and the words that both have more or lack.  So the numbers of such words alone tell that most pairs
are similar, and these are counted by numbers; the others are similar only if they share enough of these few words, which
a join of the words tells exactly.  The prefix join then takes only pairs of lines that are not of one group, and the
tokens of many prefixes are joined by classes of size.

``dedup_lines`` needs one earlier similar line, so it first
compares each line with the best of a few earlier ones that share a prefix token, the first and the last before it; most
lines of a large group of near copies are settled so, and only the others join with all earlier lines.

All of it is DataFrame functions.  Only lines are rows, so the removal of very common lines is an aggregate with
partial results, and a token that is in very many prefixes is a skewed join that the optimiser splits.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, fresh, materialize, ship, small

#: Slots of the table of token counts.
SLOTS = 1 << 16

#: Bits of a line's number in a place that is a long.
PLACE = 23

#: Longs in the bitmap of a line that is verified, a power of two, and the columns that hold them.
LONGS = 4
MAP = tuple(f"m{k}" for k in range(LONGS))
#: The columns of the smaller bitmap that every line has.
HALF = tuple(f"f{k}" for k in range(2))

#: In how many prefixes a token is that is tried for groups, and one that is joined by classes of size; the lines of the least group.
MANY = 32
CLASSES = 128
LEAST = 8

#: How many lines just before a line, among those with one of its prefix tokens, are tried first.
BEFORE = 2


def _tokens(line: Column) -> Column:
    """The words of a line, in lower case."""
    low = F.lower(line)
    parts = F.when(low.rlike("[\\x09-\\x0D]"), F.split(low, "[\\x09-\\x0D\\x20]+")).otherwise(F.split(low, " "))
    return F.array_remove(parts, "")


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, n, h1 and h2, the digest of the line, and line; blank lines are left out."""
    lines = docs.where("doc_id is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    lines = lines.where(F.col("line").rlike("[^\\x09-\\x0D\\x20]"))
    return lines.select("doc_id", "n", F.xxhash64("line").alias("h1"), F.xxhash64("line", F.lit(17)).alias("h2"), "line")


def _place(docs: DataFrame) -> Column:
    """A number that orders all lines by doc_id and n: a long if ids and texts are small enough, else a decimal."""
    r = docs.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.max(F.octet_length("text")).alias("long")).first()
    doc, n = F.col("doc_id"), F.col("n")
    if r.low is None or r.low >= 0 and r.high < 1 << 63 - PLACE and (r.long or 0) < 1 << PLACE:
        return F.shiftleft(doc, PLACE).bitwiseOR(n.cast("long"))
    return (doc.cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(11,0)") + n.cast("decimal(11,0)")).cast("decimal(38,0)")


def _slot(number: Column) -> Column:
    return number.bitwiseAND(SLOTS - 1).cast("int")


def _flips(columns: tuple[str, ...]) -> list[Column]:
    """The bitmap of the array ``numbers``: each number flips one bit."""
    none = F.lit(0).cast("long")

    def flips(k: int) -> Column:
        # the bit of each number as a constant: the step runs for each word
        bits = F.array(*(F.lit(((1 << i % 64) + (1 << 63)) % (1 << 64) - (1 << 63) if i // 64 == k else 0).cast("long") for i in range(64 * len(columns))))
        return F.aggregate("numbers", none, lambda b, x: b.bitwiseXOR(F.get(bits, x.bitwiseAND(64 * len(columns) - 1).cast("int"))))

    return [flips(k).alias(c) for k, c in enumerate(columns)]


def _column(row: str):
    """The columns of a row by name."""
    return lambda c: F.col(f"{row}.{c}")


@dataclass(frozen=True)
class Prepared:
    """``docs``: doc_id and text; ``lines``: all lines; ``distinct``: one row for each that differs, with an id, its first place, how often it is there, and size, bits and prefix of its set."""

    docs: DataFrame
    lines: DataFrame
    distinct: DataFrame
    place: Column
    threshold: float

    def rows(self, *more: str) -> DataFrame:
        """A row for each token of each prefix."""
        return self.distinct.select("id", "place", "size", *more, F.posexplode("prefix").alias("i", "token"))

    def _need(self, both: Column) -> Column:
        """How many tokens two similar sets of so many together share at least."""
        t = self.threshold
        return F.ceil(both * (t / (1 + t)) - 1e-9)

    def alike(self, x: str, y: str, columns: tuple[str, ...], of=_column) -> Column:
        """Whether no more bits differ than tokens of similar sets do."""
        a, b = of(x), of(y)
        apart = reduce(lambda p, q: p + q, (F.bit_count(a(c).bitwiseXOR(b(c))) for c in columns))
        return apart <= a("size") + b("size") - 2 * self._need(a("size") + b("size"))

    def fits(self, x: str, y: str, columns: tuple[str, ...] = ("bits",), of=_column) -> Column:
        """Whether two rows of one token may be of similar lines: length, position, and bits that differ."""
        a, b = of(x), of(y)
        # in this order, as the bits rule out most
        ok = F.least(a("size"), b("size")) >= F.greatest(a("size"), b("size")) * self.threshold - 1e-9
        ok = ok & self.alike(x, y, columns, of)
        return ok & (F.least(a("size") - a("i"), b("size") - b("i")) >= self._need(a("size") + b("size")))

    def similar(self, common: Column, both: Column) -> Column:
        """Whether sets of so many words together that share so many are similar."""
        return common >= (both - common) * self.threshold - 1e-9

    def texts(self, met: DataFrame, name: str) -> DataFrame:
        """The set of words of each row of ``met``, which has id, place, h1 and h2, with its other columns."""
        rest = [c for c in met.columns if c not in ("h1", "h2")]
        if met.schema["place"].dataType.typeName() == "long":
            # only the documents of first places are split, and only their lines digested
            n = F.col("place").bitwiseAND((1 << PLACE) - 1).cast("int").alias("n")
            asked = met.groupBy(F.shiftright("place", PLACE).alias("doc_id")).agg(F.collect_list(F.struct(n, "h1", "h2", F.struct(*rest).alias("row"))).alias("asked"))
            parts = self.docs.join(small(materialize(asked, "asked")), "doc_id").select(F.split("text", "\n").alias("parts"), "asked")
            parts = parts.select("parts", F.explode("asked").alias("at")).select("at.row", "at.h1", "at.h2", F.get("parts", F.col("at.n")).alias("line"))
            own = (F.xxhash64("line") == F.col("h1")) & (F.xxhash64("line", F.lit(17)) == F.col("h2"))  # ids may repeat
            found = parts.where(own).select("row.*", "line")
        else:
            found = self.lines.select("h1", "h2", "line").join(small(met), ["h1", "h2"])
        found = found.groupBy(*rest).agg(F.min("line").alias("line"))
        return materialize(found.select(*rest, F.array_distinct(_tokens(F.col("line"))).alias("words")), name)

    def _near(self, pairs: DataFrame, texts: DataFrame) -> DataFrame:
        """The pairs whose sets may still be similar by their whole maps."""
        numbers = F.transform("words", lambda w: F.xxhash64(w))
        maps = materialize(texts.select("id", F.explode(F.array(numbers)).alias("numbers")).select("id", F.size("numbers").alias("size"), *_flips(MAP)), "maps")
        maps = small(maps)
        near = pairs.join(maps.alias("x"), F.col("a") == F.col("x.id")).join(maps.alias("y"), F.col("b") == F.col("y.id"))
        return near.where(self.alike("x", "y", MAP)).select("a", "b")

    def verified(self, pairs: DataFrame, screen: bool = False) -> DataFrame:
        """The pairs (a, b) of ids whose sets of words are similar, and their places (pa, pb); ``screen`` for pairs of which few are: larger bitmaps rule most out first."""
        met = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
        met = materialize(self.distinct.select("id", "place", "h1", "h2").join(small(met), "id", "left_semi"), "met")
        texts = self.texts(met, "texts")
        if screen:
            pairs = self._near(pairs, texts)
        first = texts.select(F.col("id").alias("a"), F.col("place").alias("pa"), F.col("words").alias("x"))
        second = texts.select(F.col("id").alias("b"), F.col("place").alias("pb"), F.col("words").alias("y"))
        both = pairs.select("a", "b").join(first, "a").join(second, "b")
        common = F.size(F.array_intersect("x", "y"))
        both = both.select("a", "b", "pa", "pb", F.explode(F.array(F.struct(common.alias("common"), (F.size("x") + F.size("y")).alias("all")))).alias("s"))
        found = materialize(both.where(self.similar(F.col("s.common"), F.col("s.all"))).select("a", "b", "pa", "pb"), "links")
        for t in (met, texts):
            discard(t)
        return found

    def often(self) -> DataFrame:
        """The tokens of ``MANY`` prefixes or more, each with the first line that has it there."""
        often = self.rows().groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("lead")).where(F.col("n") >= MANY)
        often = materialize(often, "often")
        leads = self.distinct.select(F.col("id").alias("lead"), F.struct("id", "size", *HALF).alias("x"))
        return materialize(leads.join(small(often), "lead").select("token", "n", "x"), "often")

    def deltas(self, often: DataFrame) -> DataFrame:
        """Lines by group (g), with the words that they have more and less than most lines there, and the numbers of these.

        A line goes to the first line of one of its tokens if that may be similar, and so on.  Any groups give the same
        links.  Lines that differ in too many words from their group are left out.
        """
        tried = self.rows(*HALF).alias("y").join(small(often.select("token", "x")), "token").where((F.col("x.id") < F.col("y.id")) & self.alike("x", "y", HALF))
        up = materialize(tried.groupBy(F.col("y.id").alias("id")).agg(F.min("x.id").alias("g")), "leads")
        step = small(up.select(F.col("id").alias("g"), F.col("g").alias("next")))
        top = up
        for _ in range(3):
            top = top.join(step, "g", "left").select("id", F.coalesce("next", "g").alias("g"))
        top = materialize(top, "leads")
        heads = top.select("g").distinct().join(small(up.select(F.col("id").alias("g"))), "g", "left_anti")
        top = top.union(heads.select(F.col("g").alias("id"), "g"))
        members = self.gathered(materialize(self._large(top), "members"))
        members = self.distinct.select("id", "h1", "h2", "place").join(small(members), "id")
        words = self.texts(materialize(members, "members"), "words")
        most = words.select("g", "n", F.explode("words").alias("w")).groupBy("g", "n", "w").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") * 2 > F.col("n"))
        most = materialize(most.groupBy("g").agg(F.collect_list("w").alias("most")), "most")
        told = words.join(small(most), "g").select("id", "g", "place", F.size("words").alias("size"), F.array_except("words", "most").alias("more"), F.array_except("most", "words").alias("less"))
        told = told.select("*", F.size("more").alias("m"), F.size("less").alias("l"))
        apart = (1 - self.threshold) / (1 + self.threshold)
        found = materialize(told.where(F.col("m") + F.col("l") <= F.col("size") * 2 * apart), "deltas")
        for t in (up, words, most):
            discard(t)
        return found

    @staticmethod
    def _large(top: DataFrame) -> DataFrame:
        """The rows (id, g) of groups of ``LEAST`` lines or more, with their number n."""
        large = materialize(top.groupBy("g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST), "groups")
        return top.join(small(large), "g").select("id", "g", "n")

    def gathered(self, members: DataFrame) -> DataFrame:
        """The lines (id) by group (g) of n lines, each with the group whose middle is nearest.

        A first line may stand at the edge of its group, so that lines of one base were dealt to several groups or to none.
        The middle has the bits that most lines of a group have.  A token of many prefixes of a group stands for the group
        that has it most often, so groups of one base become one.
        """
        own = materialize(self.distinct.select("id", "size", "prefix", *HALF).join(small(members), "id"), "own")
        bits = own.select("g", "n", "size", *HALF, F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i"))
        one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
        told = bits.groupBy("g", "n", "i").agg(F.avg("size").alias("size"), *(F.sum(F.call_function("shiftright", F.col(c), F.col("i")).bitwiseAND(1)).alias(c) for c in HALF))
        most = [F.bit_or(F.when(F.col(c) * 2 > F.col("n"), F.call_function("shiftleft", one, F.col("i"))).otherwise(none)).alias(c) for c in HALF]
        middle = told.groupBy("g").agg(F.round(F.first("size")).cast("int").alias("size"), *most)
        tokens = own.select("g", "n", F.explode("prefix").alias("token")).groupBy("g", "n", "token").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") * 4 >= F.col("n"))
        tokens = tokens.groupBy("token").agg(F.max_by("g", F.struct("k", "g")).alias("g"))
        middle = materialize(tokens.join(small(materialize(middle, "middles")), "g").select("token", F.struct("g", "size", *HALF).alias("x")), "middles")
        apart = reduce(lambda p, q: p + q, (F.bit_count(F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}"))) for c in HALF))
        most_apart = F.col("y.size") * (2 * (1 - self.threshold) / (1 + self.threshold))
        tried = self.rows(*HALF).alias("y").join(small(middle), "token").where((apart <= most_apart) & (F.abs(F.col("x.size") - F.col("y.size")) <= most_apart))
        top = tried.groupBy(F.col("y.id").alias("id")).agg(F.min_by("x.g", F.struct(apart, "x.g")).alias("g"))
        found = materialize(self._large(materialize(top, "gathered")), "gathered")
        for t in (own, middle):
            discard(t)
        return found

    def within(self, deltas: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Of the lines of ``deltas``: id, links and the first place of another (other), by the pairs of a group that numbers alone tell to be similar; and the other similar pairs (a, b) of a group, with their places (pa, pb)."""
        x, y = (lambda c: F.col(f"x.{c}")), (lambda c: F.col(f"y.{c}"))
        shared, both = x("size") - x("m") - y("l"), x("size") + y("size")
        kinds = materialize(deltas.groupBy("g", "size", "m", "l").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first")), "kinds")
        sure = kinds.alias("x").join(small(kinds).alias("y"), (x("g") == y("g")) & self.similar(shared, both))
        sure = sure.groupBy(*(x(c).alias(c) for c in ("g", "size", "m", "l"))).agg(F.sum(y("n")).alias("links"), F.min(y("first")).alias("first"))
        # a line is not linked with itself
        own = F.col("size") - F.col("m") - F.col("l")
        own = self.similar(own, F.col("size") * 2).cast("int")
        sure = deltas.select("id", "g", "size", "m", "l").join(small(materialize(sure, "sure")), ["g", "size", "m", "l"])
        sure = sure.select("id", (F.col("links") - own).alias("links"), F.col("first").alias("other"))

        signed = F.concat(F.transform("more", lambda w: F.concat(F.lit("+"), w)), F.transform("less", lambda w: F.concat(F.lit("-"), w)))
        parts = deltas.select("id", "place", "g", "size", "m", "l", F.explode(signed).alias("w"))
        may = shared + F.least(x("m"), y("m")) + F.least(x("l"), y("l"))
        met = (x("g") == y("g")) & (x("w") == y("w")) & (x("id") < y("id")) & ~self.similar(shared, both) & self.similar(may, both)
        pairs = parts.alias("x").join(parts.alias("y"), met).groupBy(x("id").alias("a"), y("id").alias("b"), x("place").alias("pa"), y("place").alias("pb"), shared.alias("shared"), both.alias("both")).agg(F.count(F.lit(1)).alias("c"))
        return sure, pairs.where(self.similar(F.col("shared") + F.col("c"), F.col("both"))).select("a", "b", "pa", "pb")

    def across(self, often: DataFrame, deltas: DataFrame) -> DataFrame:
        """The pairs (a, b) of lines, not of one group, that may be similar: by the prefix of the smaller that such pairs share, and classes of size for tokens of ``often``."""
        t = self.threshold
        groups = small(deltas.select("id", (F.col("g") + 1).alias("g")))
        first = F.col("size") - F.ceil(F.col("size") * (2 * t / (1 + t)) - 1e-9) + 1

        def kind(size: Column) -> Column:
            return F.floor(F.log(size) / -math.log(t)) if 0.01 < t < 0.99 else F.lit(0).cast("long")

        rows = self.distinct.join(groups, "id", "left").select("id", "size", *HALF, F.coalesce("g", F.lit(0)).alias("g"), kind(F.col("size")).alias("k"), kind(F.col("size") * (1 / t + 1e-6) if t > 0.01 else F.col("size")).alias("last"), first.alias("first"), F.posexplode("prefix").alias("i", "token"))
        rows = rows.join(small(often.where(F.col("n") >= CLASSES).select("token", F.lit(True).alias("many"))), "token", "left")
        short = F.col("i") < F.col("first")
        # a token of many prefixes stands in the line's class, and, of the smaller line, in all that larger ones may be in
        at = F.when(F.col("many"), F.sequence("k", F.when(short, F.col("last")).otherwise(F.col("k")))).otherwise(F.array(F.lit(-1).cast("long")))
        rows = rows.select("id", "size", *HALF, "g", "i", "token", "k", short.cast("int").alias("short"), F.explode(at).alias("at"))
        own = F.when((F.col("at") == -1) | (F.col("at") == F.col("k")), 2).otherwise(0)
        # size, place in the prefix and side as one number, for shorter rows in the exchange
        packed = F.shiftleft(F.col("size").cast("long"), 32).bitwiseOR(F.shiftleft(F.col("i").cast("long"), 2)).bitwiseOR((F.col("short") + own).cast("long"))
        rows = rows.select("id", *HALF, "g", F.shiftleft(F.col("at") + 1, 40).bitwiseOR(F.col("token")).alias("token"), packed.alias("packed"))
        parts = {"size": lambda p: F.shiftright(p, 32).cast("int"), "i": lambda p: F.shiftright(p, 2).bitwiseAND((1 << 30) - 1).cast("int"), "side": lambda p: p.bitwiseAND(3)}

        def of(row: str):
            return lambda c: parts[c](F.col(f"{row}.packed")) if c in parts else F.col(f"{row}.{c}")

        x, y = of("x"), of("y")
        # told by both sides, so that both are one exchange
        same = (x("token") == y("token")) & (x("side").bitwiseAND(1) + y("side").bitwiseAND(2) == 3) & ((x("size") < y("size")) | (x("size") == y("size")) & (x("id") < y("id")))
        same = same & ((x("g") == 0) | (x("g") != y("g")))
        return rows.alias("x").join(rows.alias("y"), same & self.fits("x", "y", HALF, of)).select(x("id").alias("a"), y("id").alias("b")).distinct()


def _prepare(docs: DataFrame, threshold: float, id_col: str, text_col: str) -> Prepared:
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    lines, place = _lines(d), _place(d)

    # what stands between spaces or ends of lines: counts only order tokens, and any order gives the same result
    pieces = d.where("doc_id is not null").select(F.explode(F.split(F.lower("text"), "\n")).alias("line")).select(F.explode(F.split("line", " ")).alias("w"))
    counts = pieces.groupBy(_slot(F.xxhash64("w")).alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    # half powers of two of the count of each slot: ``SLOTS`` small numbers, which become one constant of the plan
    known = {r.slot: r.level for r in counts.select("slot", F.least(F.lit(127), F.floor(F.log2(F.col("n") + 1) * 2).cast("int")).alias("level")).collect()}
    levels = F.split(F.lit(",".join(str(known.get(i, 0) << 56) for i in range(SLOTS))), ",").cast("array<bigint>")

    # a token as a number: the level of its count above 56 bits of its hash; numbers order tokens by rarity
    def number(h: Column) -> Column:
        return F.get(levels, _slot(h)).bitwiseOR(F.shiftrightunsigned(h, 8))

    hashes = F.transform(_tokens(F.col("line")), lambda w: F.xxhash64(w))
    numbers = F.sort_array(F.transform("hashes", number))
    size = F.size("numbers")
    prefix = F.slice("numbers", 1, (size - F.ceil(size * threshold - 1e-9) + 1).cast("int"))
    # step by step: what stands over a function of words in one expression runs without generated code
    ready = lines.select(place.alias("place"), "h1", "h2", F.explode(F.array(hashes)).alias("hashes"))
    for name, step in (("hashes", F.array_distinct("hashes")), ("numbers", numbers)):
        ready = ready.select("place", "h1", "h2", F.explode(F.array(step)).alias(name))
    ready = ready.select("place", "h1", "h2", size.alias("size"), prefix.alias("prefix"), *_flips(HALF))
    distinct = ready.groupBy("h1", "h2").agg(F.min("place").alias("place"), F.count(F.lit(1)).alias("copies"), *(F.any_value(c).alias(c) for c in ("size", "prefix", *HALF)))
    # the map folded: each token flips one of 64 bits
    distinct = distinct.withColumn("bits", reduce(lambda a, b: a.bitwiseXOR(b), map(F.col, HALF)))
    # the prefix's tokens by the 40 lower bits of their hashes: they only bring candidates together
    distinct = distinct.withColumn("prefix", F.transform("prefix", lambda x: x.bitwiseAND((1 << 40) - 1)))
    return Prepared(d, lines, materialize(distinct.withColumn("id", F.monotonically_increasing_id()), "lines"), place, threshold)


def removed_lines(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document that loses lines: doc_id and removed, the numbers of these lines from 0, in order; and n_links, how many other distinct lines its lines are similar to.

    Null texts have no lines.  Blank lines stay and remove none, and so do the lines of documents with a null id.  Rows
    that repeat an id hold one place with each line number: they don't remove each other's lines there.  An empty table
    gives an empty result; other columns are not used.
    """
    p = _prepare(docs, threshold, id_col, text_col)
    often = p.often()
    deltas = p.deltas(often)
    sure, links = p.within(deltas)
    links = materialize(links, "links").union(p.verified(materialize(p.across(often, deltas), "pairs")))

    ends = links.select(F.col("a").alias("id"), F.col("pb").alias("place")).union(links.select(F.col("b").alias("id"), F.col("pa").alias("place")))
    known = ends.groupBy("id").agg(F.count(F.lit(1)).alias("links"), F.min("place").alias("other"))
    known = known.union(sure).groupBy("id").agg(F.sum("links").alias("links"), F.min("other").alias("other"))
    known = p.distinct.select("id", "h1", "h2", F.col("place").alias("first"), "copies").join(known, "id", "left").where("copies > 1 or links is not null")
    known = known.select("h1", "h2", "first", "links", (F.col("other") < F.col("first")).alias("later"))
    marked = p.lines.drop("line").join(small(materialize(known, "known")), ["h1", "h2"])
    gone = F.coalesce(F.col("later"), F.lit(False)) | (p.place > F.col("first"))
    return marked.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.when(gone, F.col("n")))).alias("removed"), F.coalesce(F.sum("links"), F.lit(0)).alias("n_links"))


def repeated_lines(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and removed, as in ``removed_lines``, without counting links: a line needs one earlier similar line."""
    p = _prepare(docs, threshold, id_col, text_col)
    order = Window.partitionBy("token").orderBy("place", "id")
    row = F.struct("id", "place", "size", "bits", "i")
    tried = p.rows("bits").select(row.alias("y"), F.array(F.first(row).over(order), *(F.lag(row, k).over(order) for k in range(1, BEFORE + 1))).alias("earlier"))
    tried = tried.select("y", F.explode("earlier").alias("x")).where((F.col("x.place") < F.col("y.place")) & p.fits("x", "y"))
    apart = F.bit_count(F.col("x.bits").bitwiseXOR(F.col("y.bits")))
    best = materialize(tried.select(F.col("y.id").alias("a"), F.col("x.id").alias("b"), apart.alias("apart")).groupBy("a").agg(F.min_by("b", "apart").alias("b")), "best")
    settled = p.verified(best, True).select(F.col("a").alias("id"))

    open_ids = settled.withColumn("open", F.lit(0))
    marked = Prepared(p.docs, p.lines, p.distinct.join(small(open_ids), "id", "left").withColumn("open", F.coalesce("open", F.lit(1))), p.place, threshold)
    x, y = marked.rows("open", *HALF).alias("x"), marked.rows("open", *HALF).alias("y")
    # y is open; told by both sides, so that both are one exchange
    same = (F.col("x.token") == F.col("y.token")) & (F.col("x.place") < F.col("y.place")) & (F.col("x.open") + 2 * F.col("y.open") >= 2)
    rest = materialize(x.join(y, same & p.fits("x", "y", HALF)).select(F.col("y.id").alias("a"), F.col("x.id").alias("b")).distinct(), "rest")
    later = settled.union(p.verified(rest, True).select(F.col("a").alias("id"))).distinct().withColumn("later", F.lit(True))

    known = p.distinct.select("id", "h1", "h2", F.col("place").alias("first"), "copies").join(later, "id", "left").where("copies > 1 or later")
    marked = p.lines.drop("line").join(known, ["h1", "h2"])
    gone = F.coalesce(F.col("later"), F.lit(False)) | (p.place > F.col("first"))
    return marked.where(gone).groupBy("doc_id").agg(F.array_sort(F.collect_set("n")).alias("removed"))


def dedup_lines(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the lines that ``removed_lines`` names, found by ``repeated_lines``: same columns and rows, a new text.

    A document that loses no line keeps its text as it is, a null text stays null.  Columns may have any names.
    """
    key, gone = fresh(docs, "doc"), fresh(docs, "removed")
    found = repeated_lines(docs, threshold, id_col, text_col).select(F.col("doc_id").alias(key), F.col("removed").alias(gone))
    kept = F.filter(F.split(F.col(text_col), "\n"), lambda _, i: ~F.array_contains(gone, i))
    text = F.when(F.size(gone) > 0, F.array_join(kept, "\n")).otherwise(F.col(text_col))
    joined = docs.join(found, F.col(id_col).cast("long") == F.col(key), "left")
    return joined.select(*(text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns))


ship(__name__)
