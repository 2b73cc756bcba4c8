r"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Seeds are found by form: e-mail addresses, IP addresses, payment cards and phone
numbers (the base spans), and hexadecimal keys. The one to three words before a
seed are its patterns. A graph joins patterns to instances (identifier-shaped
strings, seeds or not); for a few rounds a pattern's confidence is the smoothed
mean of its instances', and an instance's is that any of its patterns is right.
Strings that confident patterns point to are added as spans of kind ``id``; base
spans always stay, and no added span overlaps one.

The regular expressions are the plain ones written with possessive loops and
guards at the start of runs, so that no text makes them backtrack or recurse
deeply; they find the same leftmost non-overlapping matches. Offsets come from
the lengths of the pieces between matches, in code points.

Defined results: a null or empty text has no spans; a null id is kept as such;
repeated rows count in the graph and get the same spans; an empty table gives no
rows; without any seed nothing is added.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.scratch import Scratch

KINDS = ("email", "ip", "card", "phone", "id")
_SPACE = r"[\x20\x09-\x0D]+"
_LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
#: A run of digits with single separators, of 16 to 19 digits: no digit before or after it belongs to the run.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Identifier-shaped: eight or more letters, digits, - and _, with a digit.
SHAPE = r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])[A-Za-z0-9][A-Za-z0-9_-]{7,}+"
KEY = r"^(?=.*[0-9])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+)$"


@dataclass(frozen=True)
class Bootstrap:
    """Rounds of scoring, words of context, least confidence and distinct instances of a pattern that adds spans."""

    rounds: int = 3
    words: int = 3
    confidence: float = 0.6
    support: int = 3


_FOUND = "array<struct<kind:string,start:bigint,end:bigint,token:string,before:string>>"


def _none() -> Column:
    return F.array().cast(_FOUND)


def _last(text: Column, words: int) -> Column:
    """The last ``words`` pieces between white space, joined by one space; the last piece is empty where white space ends the text."""
    return F.array_join(F.slice(F.concat(F.array_repeat(F.lit(""), words), F.split(text, _SPACE, -1)), -words - 1, words + 1), " ")


def found(text: Column, kind: str, pattern: str, maybe: Column, words: int) -> Column:
    """Matches of ``pattern`` with offsets and the last words before; not looked for unless ``maybe``."""
    # pieces are one more than matches: piece i stands before match i
    both = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g"))
    tail = lambda out: F.when(F.size(out) > 0, F.concat_ws("", F.element_at(out, -1)["before"], F.element_at(out, -1)["token"])).otherwise("")
    one = lambda acc, x: F.struct(
        F.lit(kind).alias("kind"),
        (acc["at"] + F.length(x["g"])).cast("long").alias("start"),
        (acc["at"] + F.length(x["g"]) + F.length(x["m"])).cast("long").alias("end"),
        x["m"].alias("token"),
        _last(F.concat(tail(acc["out"]), x["g"]), words).alias("before"),
    )
    start = F.struct(F.lit(0).cast("long").alias("at"), _none().alias("out"))
    walked = F.aggregate(
        both,
        start,
        lambda acc, x: F.when(x["m"].isNull(), acc).otherwise(F.struct((acc["at"] + F.length(x["g"]) + F.length(x["m"])).cast("long").alias("at"), F.concat(acc["out"], F.array(one(acc, x))).alias("out"))),
    )["out"]
    return F.when(maybe, walked).otherwise(_none())


def luhn(token: Column) -> Column:
    digits = F.split(F.reverse(F.regexp_replace(token, "[^0-9]", "")), "")
    doubled = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(2 * d.cast("int") - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def _byte_parts(token: Column) -> Column:
    """Every dotted part is 255 at most, however many zeros lead it."""
    return F.forall(F.split(token, r"\."), lambda p: F.rlike(p, F.lit("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")))


def _digits(token: Column) -> Column:
    return F.length(F.regexp_replace(token, "[^0-9]", ""))


def base_spans(text: Column, words: int) -> Column:
    """The four base kinds, in their order, as structs kind, start, end, token, before."""
    some = F.regexp_like(text, F.lit("[0-9]"))
    email = found(text, "email", EMAIL, F.instr(text, "@") > 0, words)
    ip = F.filter(found(text, "ip", IP, F.regexp_like(text, F.lit(r"[0-9]\.[0-9]")), words), lambda x: _byte_parts(x["token"]))
    card = F.filter(found(text, "card", CARD, some, words), lambda x: luhn(x["token"]))
    phone = F.filter(found(text, "phone", PHONE, F.regexp_like(text, F.lit(r"\+[0-9]")), words), lambda x: _digits(x["token"]).between(8, 15))
    return F.concat(email, ip, card, phone)


def patterns(before: Column, words: int) -> Column:
    """Hashes of the last one to ``words`` words before an instance, in lower case and with digits as 0."""
    flat = F.split(F.trim(F.regexp_replace(F.regexp_replace(F.lower(before), "[0-9]", "0"), _SPACE, " ")), " ")
    last = [F.when((F.size(flat) >= n) & (F.element_at(flat, -1) != ""), F.xxhash64(F.lit(n), F.array_join(F.slice(flat, -n, n), " "))) for n in range(1, words + 1)]
    return F.filter(F.array(*last), lambda p: p.isNotNull())


def extract(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", cfg: Bootstrap = Bootstrap()) -> DataFrame:
    """doc_id, base and spans (arrays of kind, start, end; by kind, then start), one row per row of ``docs``."""
    scratch = Scratch(docs.sparkSession, "pii")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    first = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    seen = first.select("doc_id", base_spans(F.col("text"), cfg.words).alias("base"), found(F.col("text"), "id", SHAPE, F.regexp_like("text", F.lit("[0-9]")), cfg.words).alias("shaped"))
    apart = F.filter("shaped", lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    slim = lambda x: F.struct(
        x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), F.xxhash64(x["token"]).alias("instance"),
        ((x["kind"] != "id") | F.rlike(x["token"], F.lit(KEY))).alias("seed"), patterns(x["before"], cfg.words).alias("patterns"),
    )
    made = seen.select("doc_id", F.transform("base", slim).alias("base"), F.transform(apart, slim).alias("more")).withColumn("row", F.monotonically_increasing_id())
    made = scratch.write("found", made)

    each = made.select("row", F.explode(F.concat("base", "more")).alias("x")).select("row", "x.*")
    edges = scratch.write("edges", each.select("instance", "seed", F.explode("patterns").alias("pattern")).groupBy("pattern", "instance").agg(F.max("seed").alias("seed")))
    belief = edges.groupBy("instance").agg(F.max("seed").cast("double").alias("p"))
    for _ in range(cfg.rounds):
        scored = edges.join(belief, "instance").groupBy("pattern").agg((F.sum("p") / (F.count("*") + 1)).alias("confidence"), F.sum("p").alias("mass"))
        strong = scored.where((F.col("mass") >= cfg.support))
        belief = edges.join(strong, "pattern", "left").groupBy("instance").agg(F.when(F.max("seed"), 1.0).otherwise(1 - F.exp(F.sum(F.log(1 - F.coalesce(F.least("confidence", F.lit(0.999)), F.lit(0.0)))))).alias("p"))
    strong = scratch.write("patterns", strong).where(F.col("confidence") >= cfg.confidence).select("pattern")
    wanted = made.where(F.size("more") > 0).select("row", F.explode("more").alias("x")).select("row", "x.start", "x.end", F.explode("x.patterns").alias("pattern"))
    added = wanted.join(strong, "pattern").groupBy("row").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("added"))
    bare = lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))
    extra = F.transform(F.coalesce("added", F.array().cast("array<struct<start:bigint,end:bigint>>")), lambda x: F.struct(F.lit("id").alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return made.join(added, "row", "left").select("doc_id", F.transform("base", bare).alias("base"), F.concat(F.transform("base", bare), extra).alias("spans"))


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def report(spans: DataFrame) -> DataFrame:
    """Counts by kind, the digest of the base spans, and all spans as text."""
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return spans.select("doc_id", *[count(k) for k in KINDS[:4]], F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
