"""Personal data: patterns for well-formed kinds, and contexts learnt from them for identifiers of no known form.

Addresses, IP addresses, card and phone numbers have a form (``KINDS``) and are found by it. These seeds teach the contexts in
which such things stand, and the contexts find more (bootstrapping):

1. Texts are read as tokens, seeds as one token each. Contexts of seeds and of identifier-like tokens (with a digit) are
   lexical patterns: the two tokens before, the two behind, or one on each side. Digits in a pattern count as equal and case
   does not count. A pattern is a candidate if enough different seeds stand in it.
2. One pass over all texts finds every other token that stands in a candidate pattern: an ordinary word there speaks
   against it. Patterns and tokens (by value, so copies of a text count once) make up a graph.
3. The graph is scored in rounds. A pattern's confidence for a kind is the weight of its values known to be of the kind over
   that of all its values (and one more, so that few say little). A value's confidence is 1 minus the product of its accepted
   patterns' doubts. Values that reach the threshold join the known ones and speak for further patterns.
4. Where an accepted value stands in an accepted pattern, its place is added under the kind.

Columns and SQL functions only. Positions come from prefix sums over token lengths inside a row; what is shuffled are
identifier-like tokens and tokens in candidate patterns. Which patterns are candidates is told to the second pass by a bit map
of at most ``map_bits`` bits (16 MB), whose false positives fall out in the join behind it. Seeds and words in common
contexts are counted by value before anything is joined.

Defined cases: a null text is empty; an empty text has no spans and the checksum of the empty string; rows of one id are told
apart by their text; repeated rows get equal results; a null id is an id of its own; positions are code points; an empty
table gives an empty result; columns other than id and text are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barlab.llm.frames import written

# Possessive forms of: email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+, ip [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+),
# card [0-9]([\x20-]?[0-9])+, phone \+[0-9][\x20().0-9-]+[0-9]; they match the same strings without backtracking over long runs.
KINDS: dict[str, str] = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: Marks a seed in a text: mark, kind's letter, hash of its value, its length in code points.
MARK = "\ue000"
SEED = MARK + "[a-d][0-9a-f]{16}:[0-9]++;"
_WORD = r"|[\p{L}\p{N}]++(?:[-_./'][\p{L}\p{N}]++)*+|[:=#@]"
TOKEN = SEED + _WORD
#: The same tokens where marks are cut to their kinds.
COARSE = MARK + "[a-d]" + _WORD


def valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, F.lit("[^0-9]"), F.lit(""))
    return {
        "email": lambda: F.lit(True),
        "ip": lambda: m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"),
        "card": lambda: F.length(digits).between(16, 19) & F.coalesce(F.call_function("luhn_check", digits), F.lit(False)),
        "phone": lambda: F.length(digits).between(8, 15),
    }[kind]()


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often the body (or a lambda in it) reads it."""
    return F.transform(F.array(value), lambda v: body(v))[0]


def before_each(lengths: Column, block: int = 64) -> Column:
    """Sums of the elements before each element of an array of whole numbers: by blocks, so long arrays stay cheap."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)

    def of_array(a: Column) -> Column:
        starts = F.when(F.size(a) > 0, F.sequence(F.lit(0), F.floor((F.size(a) - 1) / block).cast("int"))).otherwise(F.array().cast("array<int>"))
        part = lambda b: F.slice(a, b * block + 1, block)
        inside = lambda p, base: F.transform(p, lambda _, i: base + total(F.slice(p, F.lit(1), i)))
        of_block = lambda b, sums: let(F.struct(part(b).alias("part"), total(F.slice(sums, F.lit(1), b)).alias("base")), lambda x: inside(x["part"], x["base"]))
        return let(F.transform(starts, lambda b: total(part(b))), lambda sums: F.flatten(F.transform(starts, lambda b: of_block(b, sums))))

    return let(lengths, of_array)


def matches(text: Column, kind: str) -> Column:
    """Struct of all matches of a kind's form in a text (found) and the pieces of text around them (around, one more)."""
    pattern = F.lit(KINDS[kind])
    return F.struct(F.regexp_extract_all(text, pattern, F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("around"))


def base_spans(text: str, kind: str) -> Column:
    """Array of (start, end) of a kind's valid matches in column ``text``."""

    def spans(x: Column) -> Column:
        pairs = F.zip_with(F.slice(x["around"], F.lit(1), F.size(x["found"])), x["found"], lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("long"), valid(kind, m).alias("ok")))
        return let(pairs, lambda p: F.zip_with(before_each(F.transform(p, lambda y: y["gap"] + y["long"])), p, lambda s, y: F.struct((s + y["gap"]).alias("start"), (s + y["gap"] + y["long"]).alias("end"), y["ok"].alias("ok"))))

    kept = F.transform(F.filter(let(matches(F.col(text), kind), spans), lambda s: s["ok"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    none = F.array().cast("array<struct<start:int,end:int>>")
    return F.when(F.col(text).rlike(KINDS[kind]), kept).otherwise(none)


def _marked(text: Column, letter: str, kind: str) -> Column:
    """A text with a mark in place of each valid match of a kind."""
    mark = lambda m: F.concat(F.lit(MARK + letter), F.substring(F.md5(m), 1, 16), F.lit(":"), F.length(m).cast("string"), F.lit(";"))
    parts = lambda x: F.zip_with(x["around"], x["found"], lambda g, m: F.concat(g, F.when(m.isNull(), "").when(valid(kind, m), mark(m)).otherwise(m)))
    return F.when(text.rlike(KINDS[kind]), F.array_join(let(matches(text, kind), parts), "")).otherwise(text)


def with_seeds_masked(text: Column, body) -> Column:
    """``body`` of the text with a mark in place of each seed, kind after kind."""
    steps = list(zip("abcd", KINDS))

    def after(i: int, t: Column) -> Column:
        return body(t) if i == len(steps) else let(_marked(t, *steps[i]), lambda m: after(i + 1, m))

    return after(0, text)


def _identifier(t: Column) -> Column:
    return t.rlike("[0-9]") & (F.length(t) >= 5)


#: Tables of tokens are cut into slices of 1, 7 and 56 of 64 parts, by a hash of the row.
SLICES = (1, 8, 64)


def tokens_of(docs: DataFrame) -> DataFrame:
    """(id, th, plain, hits, slice): a text's tokens as patterns see them (small letters, numbers as 0, a seed as its kind), and
    its seeds and identifier-like tokens as (i, value, kind), kind being null for the latter."""
    seed = lambda t: t.startswith(MARK)
    kind = lambda t: F.when(seed(t), F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.ascii(F.substring(t, 2, 1)) - 96))
    hit = lambda t, i: F.when(seed(t) | _identifier(t), F.struct(i.alias("i"), F.lower(t).alias("value"), kind(t).alias("kind")))
    none = F.array().cast("array<struct<i:int,value:string,kind:string>>")
    # only a text with a digit has seeds or identifiers (marks hold digits)
    hits = lambda m: F.when(m.rlike("[0-9]"), F.array_compact(F.transform(F.regexp_extract_all(m, F.lit(TOKEN), F.lit(0)), hit))).otherwise(none)
    coarse = lambda m: F.when(m.rlike("[0-9]"), F.regexp_replace(F.regexp_replace(m, F.lit(f"({MARK}[a-d])[0-9a-f]{{16}}:[0-9]++;"), F.lit("$1")), F.lit("[0-9]+"), F.lit("0"))).otherwise(m)
    plain = lambda m: F.transform(F.regexp_extract_all(coarse(m), F.lit(COARSE), F.lit(0)), lambda t: F.lower(t))
    part = F.pmod(F.xxhash64("id", "th"), F.lit(SLICES[-1]))
    slice_ = sum((F.when(part >= s, 1).otherwise(0) for s in SLICES[:-1]), F.lit(0))
    rows = docs.select("id", "th", slice_.alias("slice"), with_seeds_masked(F.col("text"), lambda m: F.struct(plain(m).alias("plain"), hits(m).alias("hits"))).alias("x"))
    return rows.select("id", "th", "x.plain", "x.hits", "slice")


def contexts(i: Column) -> list[Column]:
    """Hashes of the three patterns in which token ``i`` (from 0) of column plain stands; beyond the text's ends is nothing."""
    at = lambda d: F.get("plain", i + d)
    return [F.xxhash64(F.lit(side), at(a), at(b)) for side, a, b in (("before", -2, -1), ("behind", 1, 2), ("around", -1, 1))]


def sightings(tokens: DataFrame) -> DataFrame:
    """(id, th, i, value, kind, pattern): seeds and identifier-like tokens with each of their contexts."""
    rows = tokens.select("id", "th", "plain", F.explode("hits").alias("hit"))
    return rows.select("id", "th", "hit.*", F.explode(F.array(*contexts(F.col("hit.i")))).alias("pattern"))


def bit_map(patterns: DataFrame, map_bits: int) -> list[int]:
    """Bits of the patterns' hashes, 64 to a word; doubled in size with the patterns up to ``map_bits`` bits."""
    bits = 1 << 16
    count = patterns.count()
    while bits < min(16 * count, map_bits):
        bits *= 2
    place = F.pmod(F.col("pattern"), F.lit(bits))
    words = patterns.select(F.floor(place / 64).cast("int").alias("w"), F.expr("shiftleft(1L, cast(pattern & 63 as int))").alias("bit")).groupBy("w").agg(F.bit_or("bit").alias("bits"))
    out = [0] * (bits // 64)
    for row in words.collect():  # at most map_bits / 64 rows
        out[row["w"]] = row["bits"]
    return out


def ordinary(tokens: DataFrame, patterns: DataFrame, map_bits: int) -> DataFrame:
    """(pattern, words): how many different ordinary words stand in each pattern, from (pattern, most, first).

    A pattern in which more than ``most`` stand is left out. That shows in few texts for most of them, so slices of
    the texts are gone through one after the other, each with the patterns that the ones before have left; every text counts.
    Once more than ``first`` stand in every pattern, none can be accepted in the first round, so none ever is: all are left out.
    """
    pairs, patterns = None, patterns.withColumn("words", F.lit(0).cast("bigint"))
    for number in range(len(SLICES)):
        if patterns.where("words <= first").isEmpty():
            return patterns.select("pattern", "words").where("false")
        words = bit_map(patterns, map_bits)
        one = tokens.sparkSession.createDataFrame([(0, words)], "one int, bits array<bigint>")  # of at most map_bits / 8 bytes
        rows = tokens.where(F.col("slice") == number).withColumn("one", F.lit(0)).join(F.broadcast(one), "one")
        found = rows.select(F.explode(_ordinary_in("plain", 64 * len(words))).alias("x")).select(F.explode("x.patterns").alias("pattern"), F.xxhash64("x.token").alias("word")).distinct()
        found = found.join(patterns.select("pattern"), "pattern", "left_semi")
        pairs = written(found if pairs is None else pairs.join(patterns.select("pattern"), "pattern", "left_semi").unionByName(found).distinct())
        counts = pairs.groupBy("pattern").agg(F.count("*").alias("words"))
        patterns = written(patterns.select("pattern", "most", "first").join(counts, "pattern", "left").withColumn("words", F.coalesce("words", F.lit(0).cast("bigint"))).where("words <= most"))
    return patterns.select("pattern", "words")


def _ordinary_in(plain: str, bits: int) -> Column:
    """(token, patterns) of the ordinary words of a text whose contexts may be asked for."""

    def hit(p: Column) -> Column:
        word = F.get("bits", F.floor(F.pmod(p, F.lit(bits)) / 64).cast("int"))
        return F.getbit(word, p.bitwiseAND(63).cast("int")) == 1

    each = F.transform(plain, lambda t, i: F.when(~t.startswith(MARK) & ~t.contains("0"), F.struct(t.alias("token"), F.filter(F.array(*contexts(i)), hit).alias("patterns"))))
    return F.filter(each, lambda x: F.size(x["patterns"]) > 0)


def score(edges: DataFrame, against: DataFrame, rounds: int, pattern_least: float, value_least: float, unknown: float) -> tuple[DataFrame, DataFrame] | None:
    """(accepted patterns (pattern, kind), accepted values (value, kind)) after at most ``rounds`` rounds.

    ``edges`` has (pattern, value, kind): different values per pattern, kind null for tokens of no known form.
    """
    open_ = written(edges.where("kind is null").select("pattern", "value"))
    seeds = edges.where("kind is not null").groupBy("pattern", "kind").agg(F.count("*").alias("seeds"))
    fixed = edges.groupBy("pattern").agg(F.count("kind").alias("known"), F.count_if(F.col("kind").isNull()).alias("others")).join(against, "pattern")
    base = written(seeds.join(fixed, "pattern"))
    belief = None
    for _ in range(rounds):
        if belief is None:
            gained = base.withColumn("gain", F.lit(0.0))
        else:
            more = open_.join(belief, "value").groupBy("pattern", "kind").agg(F.sum("confidence").alias("gain"))
            gained = base.join(more, ["pattern", "kind"], "left").withColumn("gain", F.coalesce("gain", F.lit(0.0)))
        weight = F.col("seeds") + F.col("gain")
        total = F.col("known") + F.col("words") + F.greatest("gain", unknown * F.col("others")) + 1
        good = written(gained.select("pattern", "kind", (weight / total).alias("confidence")).where(F.col("confidence") >= pattern_least))
        doubt = open_.join(good, "pattern").groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("confidence")).where(F.col("confidence") >= value_least)
        # a value is of one kind: the surer one
        best = doubt.groupBy("value").agg(F.max_by("kind", F.struct("confidence", "kind")).alias("kind"), F.max("confidence").alias("confidence"))
        now = written(best)
        before, belief = belief, now
        if now.isEmpty() or before is not None and now.join(before, ["value", "kind"], "left_anti").isEmpty():
            break
    return (good, belief) if belief is not None and not belief.isEmpty() else None


def limits(edges: DataFrame, pattern_least: float, unknown: float) -> DataFrame:
    """(pattern, most, first): with more than ``most`` ordinary words a pattern never reaches the threshold, with more than
    ``first`` not in the first round, where no value is believed yet. Confidence grows with the beliefs, of at most 1 a value."""
    seeds = edges.groupBy("pattern", "kind").agg(F.count("*").alias("count"))
    of = lambda c: F.coalesce(F.sum(F.when(c, F.col("count"))), F.lit(0))
    each = seeds.groupBy("pattern").agg(F.max(F.when(F.col("kind").isNotNull(), F.col("count"))).alias("seeds"), of(F.col("kind").isNotNull()).alias("known"), of(F.col("kind").isNull()).alias("others"))
    words = lambda weight, against: F.floor(weight / pattern_least + 1e-6 - F.col("known") - against - 1)
    most = words(F.col("seeds") + F.col("others"), F.col("others") * max(1.0, unknown))
    return each.select("pattern", most.alias("most"), words(F.col("seeds"), F.col("others") * unknown).alias("first")).where("most >= 0")


def discovered(docs: DataFrame, least_seeds: int = 3, rounds: int = 4, pattern_least: float = 0.6, value_least: float = 0.8, unknown: float = 0.5, map_bits: int = 1 << 27) -> DataFrame | None:
    """(id, th, added): spans (kind, start, end) of identifiers found by context alone in rows (id, th, text); None without any."""
    tokens = written(tokens_of(docs), "slice")
    seen = written(sightings(tokens))
    edges = seen.groupBy("pattern", "value").agg(F.max("kind").alias("kind"))
    support = seen.where("kind is not null").select("pattern", "value").distinct().groupBy("pattern").agg(F.count("*").alias("seeds")).where(F.col("seeds") >= least_seeds)
    # a pattern that finds nothing but seeds has nothing to add
    useful = written(support.join(seen.where("kind is null").select("pattern").distinct(), "pattern", "left_semi").select("pattern"))
    if useful.isEmpty():
        return None
    edges = written(edges.join(useful, "pattern", "left_semi"))
    told = score(edges, written(ordinary(tokens, written(limits(edges, pattern_least, unknown)), map_bits)), rounds, pattern_least, value_least, unknown)
    if told is None:
        return None
    patterns, values = told
    places = seen.where("kind is null").drop("kind").join(values.select("value", "kind"), "value").join(patterns.select("pattern", "kind"), ["pattern", "kind"], "left_semi").select("id", "th", "i", "kind").distinct()
    per = written(places.groupBy("id", "th").agg(F.collect_list(F.struct("i", "kind")).alias("hits")))  # of one text
    p = per.select(F.col("id").alias("pid"), F.col("th").alias("pth"), "hits")
    met = docs.join(p, F.col("id").eqNullSafe(F.col("pid")) & (F.col("th") == F.col("pth"))).select("id", "th", "hits", "text").dropDuplicates(["id", "th"])
    cut = lambda m: F.struct(F.regexp_extract_all(m, F.lit(TOKEN), F.lit(0)).alias("tokens"), F.split(m, TOKEN, -1).alias("around"))
    return met.select("id", "th", with_seeds_masked(F.col("text"), lambda m: let(cut(m), _places)).alias("added"))


def _places(text: Column) -> Column:
    """Spans of the tokens numbered in ``hits``; a mark counts as long as the seed that it stands for."""
    long = lambda t: F.when(t.startswith(MARK), F.split_part(F.split_part(t, F.lit(":"), F.lit(2)), F.lit(";"), F.lit(1)).cast("int")).otherwise(F.length(t))
    steps = F.zip_with(F.slice(text["around"], F.lit(1), F.size(text["tokens"])), text["tokens"], lambda g, t: F.struct(F.length(g).alias("gap"), long(t).alias("long")))
    place = lambda s, x, h: F.struct(h["kind"].alias("kind"), (F.get(s, h["i"]) + F.get(x, h["i"])["gap"]).alias("start"), (F.get(s, h["i"]) + F.get(x, h["i"])["gap"] + F.get(x, h["i"])["long"]).alias("end"))
    return let(steps, lambda x: let(before_each(F.transform(x, lambda y: y["gap"] + y["long"])), lambda s: F.transform("hits", lambda h: place(s, x, h))))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) of every row: spans by form, and all spans."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    base = written(rows.select("id", "th", *[base_spans("text", k).alias(k) for k in KINDS]))
    added = discovered(rows, **options)
    if added is None:
        out = base.withColumn("added", F.array().cast("array<struct<kind:string,start:int,end:int>>"))
    else:
        a = written(added).select(F.col("id").alias("aid"), F.col("th").alias("ath"), "added")
        out = base.join(a, F.col("id").eqNullSafe(F.col("aid")) & (F.col("th") == F.col("ath")), "left").withColumn("added", F.coalesce("added", F.array().cast("array<struct<kind:string,start:int,end:int>>")))
    shown = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    own = lambda k: F.transform(F.col(k), lambda s: F.struct(F.lit(k).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    clash = lambda s: reduce(lambda x, y: x | y, [F.exists(F.col(k), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])) for k in KINDS])
    out = out.withColumn("added", F.filter("added", lambda s: ~clash(s)))
    of_kind = lambda k: F.filter("added", lambda s: s["kind"] == k)
    in_order = lambda spans: F.array_sort(spans, lambda a, b: a["start"] - b["start"])
    every = F.flatten(F.array(*[in_order(F.concat(own(k), of_kind(k))) for k in KINDS]))
    base_text = F.array_join(F.transform(F.flatten(F.array(*[own(k) for k in KINDS])), shown), ",")
    return out.select(F.col("id").alias(id_col), *[F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS], F.sha2(base_text, 256).alias("base_sha256"), F.array_join(F.transform(every, shown), ",").alias("spans"), F.size("added").cast("bigint").alias("n_added"))
