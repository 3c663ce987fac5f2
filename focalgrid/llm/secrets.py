"""Secrets in texts: fixed patterns, and a sliding-window Shannon entropy over candidate strings.

All of it is DataFrame functions.  A text is cut at the matches of a pattern by a mark that no pattern matches, so the
places of the matches are the running sums of the lengths of its parts.

Entropy: a candidate is a long enough run of one character class that holds digits and letters.  A window slides over
it; the counts of its characters, and the sum of count * log2(count), change by the one that enters and the one that
leaves.  Windows at or over the class's limit are merged to spans.  Candidates on the allow-list give none.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MARK = "\x01"


@dataclass(frozen=True)
class CharacterClass:
    """Runs of ``pattern`` characters are scanned by windows of ``window`` characters for ``bits`` bits of entropy a character."""

    kind: str
    pattern: str
    must: str
    letters: str
    window: int
    bits: float


#: The classes; a run that two of them accept is scanned by each.
CLASSES = (
    CharacterClass("hex-entropy", "[0-9a-fA-F]{20,}", "[0-9].*[a-fA-F]|[a-fA-F].*[0-9]", "0123456789abcdefABCDEF", 20, 3.0),
    CharacterClass("base64-entropy", "[A-Za-z0-9+/_=-]{24,}", "^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 24, 4.0),
)

#: Candidates that match give no entropy span: placeholders, ordered alphabets, and identifiers that aren't secret.
ALLOW = r"(?i)example|sample|placeholder|changeme|your[_-]|xxxx|0123456789|abcdefghij|^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$|^sha(1|256|384|512)-"

#: Fixed patterns: kind, pattern, and which matches count (by the text of the match).
ASSIGN = r"""((?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)"""
BASE = (
    ("assign", ASSIGN, r"^(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{6}"),
    ("access", r"(AKIA[A-Z0-9]{16,})()", r"^.{20}"),
    ("hex", r"([0-9a-f]{24,})()", r"^.{24}"),
)


def _cut(text: Column, pattern: str) -> Column:
    """The text's parts: at odd places the matches, at even ones what lies between."""
    return F.split(F.regexp_replace(text, pattern, f"{_MARK}$0{_MARK}"), _MARK)


def _matches(parts: Column, kind: str, good) -> Column:
    """array<struct<start, end, kind, match>> of the matches that are good."""
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("i"), F.array().cast("array<struct<start:int,end:int,kind:string,match:string>>").alias("out"))

    def step(state: Column, part: Column) -> Column:
        end = state["at"] + F.char_length(part)
        found = F.struct(state["at"].alias("start"), end.alias("end"), F.lit(kind).alias("kind"), part.alias("match"))
        out = F.when((state["i"] == 1) & good(part), F.array_append(state["out"], found)).otherwise(state["out"])
        return F.struct(end.alias("at"), (1 - state["i"]).alias("i"), out.alias("out"))

    none = F.array().cast("array<struct<start:int,end:int,kind:string,match:string>>")
    return F.when(F.size(parts) > 1, F.aggregate(parts, zero, step)["out"]).otherwise(none)


def entropy_spans(candidate: Column, of: CharacterClass) -> Column:
    """array<struct<start, end>> of the merged windows of a candidate whose entropy is at or over the limit.

    A step takes the code of the character that enters the window and of the one that leaves it, and changes their two
    counts, which are packed into a few longs: it costs the same wherever in the candidate it is.
    """
    w = of.window
    kinds = "array<struct<start:int,end:int>>"
    width = w.bit_length()  # bits of a count
    per = 63 // width
    longs = -(-len(of.letters) // per)
    one, mask = F.lit(1).cast("long"), (1 << width) - 1

    def weight(n: Column) -> Column:
        return F.when(n > 1, n * F.log2(n.cast("double"))).otherwise(F.lit(0.0))

    def count(counts: Column, code: Column) -> Column:
        packed = F.get(counts, F.floor(code / per).cast("int"))
        return F.call_function("shiftright", packed, (code % per * width).cast("int")).bitwiseAND(mask).cast("int")

    def unit(code: Column, k: Column) -> Column:
        return F.when(F.floor(code / per) == k, F.call_function("shiftleft", one, (code % per * width).cast("int"))).otherwise(F.lit(0).cast("long"))

    def step(state: Column, x: Column) -> Column:
        i, new, old = state["i"] + 1, x["new"], x["old"]
        counts = state["counts"]
        up = count(counts, new)
        down = F.when(old >= 0, count(counts, old)).otherwise(0)
        changed = F.when(
            old == new,
            F.struct(counts.alias("counts"), state["sum"].alias("sum")),
        ).otherwise(
            F.struct(
                F.transform(counts, lambda c, k: c + unit(new, k) - F.when(old >= 0, unit(old, k)).otherwise(F.lit(0).cast("long"))).alias("counts"),
                (state["sum"] + weight(up + 1) - weight(up) + weight(down - 1) - weight(down)).alias("sum"),
            )
        )
        # sum is w * (log2(w) - entropy); the small term allows for its rounding
        high = (i >= w) & (changed["sum"] <= w * (F.log2(F.lit(float(w))) - of.bits) + 1e-9)
        spans = state["spans"]
        last = F.try_element_at(spans, F.lit(-1))
        span = F.struct((i - w).alias("start"), i.alias("end"))
        joined = F.when(last["end"] >= i - w, F.array_append(F.slice(spans, 1, F.size(spans) - 1), F.struct(last["start"].alias("start"), i.alias("end")))).otherwise(F.array_append(spans, span))
        return F.struct(i.alias("i"), changed["counts"].alias("counts"), changed["sum"].alias("sum"), F.when(high, joined).otherwise(spans).alias("spans"))

    zero = F.struct(F.lit(0).alias("i"), F.array_repeat(F.lit(0).cast("long"), longs).alias("counts"), F.lit(0.0).alias("sum"), F.array().cast(kinds).alias("spans"))
    codes = F.transform(F.split(candidate, ""), lambda c: F.instr(F.lit(of.letters), c) - 1)
    left = F.slice(F.concat(F.array_repeat(F.lit(-1), w), codes), 1, F.char_length(candidate))
    return F.aggregate(F.arrays_zip(codes.alias("new"), left.alias("old")), zero, step)["spans"]


def _entropy(text: Column, of: CharacterClass) -> Column:
    """array<struct<start, end, kind>> of the entropy spans of a text."""
    kinds = "array<struct<start:int,end:int,kind:string>>"
    runs = _matches(_cut(text, of.pattern), of.kind, lambda m: m.rlike(of.must) & ~m.rlike(ALLOW))
    spans = F.flatten(F.transform(runs, lambda r: F.transform(entropy_spans(r["match"], of), lambda s: F.struct((r["start"] + s["start"]).alias("start"), (r["start"] + s["end"]).alias("end"), F.lit(of.kind).alias("kind")))))
    return F.when(F.size(runs) > 0, spans).otherwise(F.array().cast(kinds))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", classes: tuple[CharacterClass, ...] = CLASSES) -> DataFrame:
    """One row a row of ``docs``: doc_id, base and entropy, arrays of struct<start, end, kind>, in code points, by start and then by kind as listed.

    ``base`` holds the matches of the fixed patterns, ``entropy`` what the entropy adds.  A null or empty text has
    none.  Rows that repeat are scanned each; a null id is carried; an empty table gives an empty result; other columns
    are not used.  Nothing is shuffled.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), _MARK, "\x02").alias("text"))
    for kind, pattern, counts in BASE:
        d = d.withColumn(f"_{kind}", _matches(_cut(F.col("text"), pattern), kind, lambda m, counts=counts: m.rlike(counts)))
    for c in classes:
        d = d.withColumn(f"_{c.kind}", _entropy(F.col("text"), c))
    order = {kind: i for i, kind in enumerate([*(b[0] for b in BASE), *(c.kind for c in classes)])}

    def ordered(names: list[str]) -> Column:
        rank = F.create_map(*(F.lit(x) for pair in order.items() for x in pair))
        every = F.concat(*(F.transform(F.col(f"_{n}"), lambda s: F.struct(s["start"].alias("start"), F.element_at(rank, s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))) for n in names))
        return F.transform(F.array_sort(every), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))

    base = [b[0] for b in BASE]
    return d.select("doc_id", ordered(base).alias("base"), ordered([c.kind for c in classes]).alias("entropy"), *(F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in base), ordered([*base, *(c.kind for c in classes)]).alias("every"))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined with commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
