"""Benchmark decontamination by template canonicalisation.

A text becomes a sequence of template tokens: words in lower case, numbers and units of measure as
typed placeholders; punctuation goes. The *item* alone says which further places are names: a capital inside
a sentence, or one that begins a sentence. Its windows of ``WINDOW`` tokens are read plain, with the sure names
open, and with all names open (at most ``MOST_NAMES``); an open place takes any word. So a verbatim copy is
found in any case of letters, and a re-parameterised one whatever its names look like.

A document's windows are made where they can match: a bitmap of bounded size knows the pairs of tokens
that stand side by side or one apart in an item. A pattern of open places that the benchmark has fits a
window if all such pairs of its closed places are known. The window is hashed once for each pattern that
fits, and joined with the item windows by hash. The values behind placeholders and open places (slots) of an alignment (a
document's window place less the item's) must map the item's values to the document's one to one:
readings of windows that break the mapping do not count.

A document is contaminated by an item if the consistent windows are at least ``SHARE`` of the item's
windows, or if ``RUN`` consecutive tokens match, which catches parts of longer items. A window that an item
repeats stands for all its places. An item of fewer tokens than a window matches a whole document, or a
stretch between ends of sentences or lines that has just its tokens, numbers included; items without
tokens match nothing.

DataFrame operations only. Documents are not shuffled: the benchmark's windows are broadcast if
they are at most ``BROADCAST_WINDOWS`` of ``BROADCAST_BYTES`` and joined by hash otherwise. Only matched
windows are shuffled, and grouped by document and item.

Defined cases: null or empty documents are clean; null items are ignored; each row is judged by its own
text, also without a doc_id, and repeated rows alike; an empty benchmark finds nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from regionloom.session import checkpointed

WINDOW = 5
SHARE = 0.8
RUN = 13
#: With two open places of five, two closed ones are always neighbours or one apart.
MOST_NAMES = 2
BROADCAST_BYTES = 64 << 20
BROADCAST_WINDOWS = 1 << 20
#: Bits of the bitmap of pairs: 64 for each different pair, between these bounds.
BITMAP = (1 << 12, 1 << 20)

# fixed values: units of measure that follow a number
UNITS = ["%", "percent", "km", "m", "cm", "mm", "mi", "miles", "mile", "ft", "feet", "foot", "inch", "inches", "kg", "g", "mg", "lb", "lbs",
         "pounds", "oz", "l", "ml", "litres", "liters", "s", "sec", "seconds", "min", "minutes", "h", "hours", "hour", "days", "day",
         "weeks", "week", "months", "years", "dollars", "euros", "usd", "eur", "cents", "degrees", "mph", "kmh", "w", "kw", "kwh", "v", "hz", "mb", "gb"]

_NAME = "\u0001"
_SEP = "\u0002"
_MAYBE = "\u0003"
_NUMBER, _UNIT, _OPEN = -1, -2, 0
#: Ends of sentences and lines, and what may close a sentence.
_EDGE = r"[.!?](?=[\s\p{P}]|$)|[\r\n]+"


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _tokens(text: Column, marks: str = "") -> Column:
    """Lower-case words of letters and digits in order; numbers keep no separators and stand apart from their unit."""
    joined = F.regexp_replace(F.lower(text), r"(?<=[0-9])[.,](?=[0-9])", "")
    parted = F.regexp_replace(joined, r"(?<=[0-9])(?=[\p{L}%])", " ")
    return F.array_remove(F.split(parted, r"[^\p{L}\p{M}\p{N}%" + marks + "]+"), "")


def _marked_tokens(text: Column) -> Column:
    """Tokens of an item; names and words that may be names carry a mark."""
    # a capital after a letter or a comma and one space begins a name, as it begins no sentence
    marked = F.regexp_replace(text, r"(?<=[\p{Ll},;:] )(\p{Lu})(?=\p{Ll})", _NAME + "$1")
    # any other capital that begins a word may begin a sentence or a name
    marked = F.regexp_replace(marked, r"(?<![\p{L}\p{M}\p{N}" + _NAME + r"])(\p{Lu})(?=\p{Ll})", _MAYBE + "$1")
    return _tokens(marked, _NAME + _MAYBE)


def _codes(words: Column) -> Column:
    """A number for each token: of the word, or that of its placeholder. A unit is one only behind a number."""
    numeric = lambda w: F.substring(w, 1, 1).between("0", "9")
    return F.transform(words, lambda w, i: F.when(numeric(w), _NUMBER).when(
        w.isin(UNITS) & (i > 0) & numeric(F.get(words, i - 1)), _UNIT).otherwise(F.xxhash64(w)))


def _is_slot(code: Column) -> Column:
    return code.isin(_NUMBER, _UNIT)


def _window_hash(codes: Column, open_: Column, n: Column) -> Column:
    """Of the window's first ``n`` codes (at most WINDOW): an open place counts as open if a word stands there."""
    at = [F.get(codes, F.lit(j)) for j in range(WINDOW)]
    seen = [F.when((open_.bitwiseAND(1 << j) != 0) & ~_is_slot(c), F.lit(_OPEN).cast("long")).otherwise(c) for j, c in enumerate(at)]
    return F.xxhash64(open_, n, *seen)


def _slots(words: Column, codes: Column, open_: Column) -> Column:
    """The values behind placeholders and open places, joined in order ('' for none); the kind stands before each."""
    parts = []
    for j in range(WINDOW):
        c, w = F.get(codes, F.lit(j)), F.get(words, F.lit(j))
        parts.append(F.when(_is_slot(c), w).when(open_.bitwiseAND(1 << j) != 0, F.concat(F.lit(_NAME), w)))
    return F.concat_ws(_SEP, *parts)


def _starts(words: Column) -> Column:
    """Places of a text's windows; a shorter text has one of its own length."""
    n = F.size(words)
    return F.when(n >= WINDOW, F.sequence(F.lit(0), n - WINDOW)).when(n > 0, F.array(F.lit(0)))


def item_windows(benchmark: DataFrame) -> DataFrame:
    """(item_id, item_pos, n, open, hash, item_slots): the windows of the items in all their readings."""
    rows = benchmark.filter("item_id is not null and text is not null").select("item_id", _marked_tokens(F.col("text")).alias("raw_"))
    rows = rows.withColumn("words_", F.transform("raw_", lambda w: F.ltrim(F.ltrim(w, F.lit(_NAME)), F.lit(_MAYBE))))
    rows = rows.withColumn("codes_", _codes(F.col("words_"))).select("*", F.explode(_starts(F.col("words_"))).alias("item_pos"))
    cut = lambda c: F.slice(c, F.col("item_pos") + 1, F.lit(WINDOW))
    rows = rows.select("item_id", "item_pos", *[cut(c).alias(c) for c in ("raw_", "words_", "codes_")]).withColumn("n", F.size("words_"))

    def bits(marks: list[str]) -> Column:
        first = [F.substring(F.get("raw_", F.lit(j)), 1, 1) for j in range(WINDOW)]
        return sum((F.when(c.isin(marks) & ~_is_slot(F.get("codes_", F.lit(j))), 1 << j).otherwise(0) for j, c in enumerate(first)), F.lit(0))

    readings = F.array(F.lit(0), bits([_NAME]), bits([_NAME, _MAYBE]))
    allowed = F.when(F.col("n") < WINDOW, F.array(F.lit(0))).otherwise(F.filter(F.array_distinct(readings), lambda m: F.bit_count(m) <= MOST_NAMES))
    rows = rows.withColumn("open", F.explode(allowed))
    return rows.select("item_id", "item_pos", "n", "open", "codes_", _window_hash(F.col("codes_"), F.col("open"), F.col("n")).alias("hash"),
                       _slots(F.col("words_"), F.col("codes_"), F.col("open")).alias("item_slots"))


def _pair(a: Column, b: Column, gap: int) -> Column:
    return F.xxhash64(a, b, F.lit(gap))


def _bitmap(own: DataFrame) -> list[int]:
    """A bitmap of the pairs of neighbours and of tokens one apart in ``codes_``, as long integers."""
    at = [F.get("codes_", F.lit(j)) for j in range(WINDOW)]
    pairs = F.array(*[_pair(at[j], at[j + gap], gap) for gap in (1, 2) for j in range(WINDOW - gap)])
    pairs = own.select(F.explode(pairs).alias("p_"))
    n, size = pairs.select(F.approx_count_distinct("p_")).first()[0], BITMAP[0]
    while size < min(64 * n, BITMAP[1]):
        size *= 2
    word, bit = F.shiftrightunsigned("p_", 6).bitwiseAND(size // 64 - 1), F.col("p_").bitwiseAND(63)
    words = pairs.select(word.alias("w"), bit.cast("int").alias("b")).distinct()
    words = words.groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("m"))
    out = [0] * (size // 64)
    for r in words.collect():  # at most the bitmap's size
        out[r["w"]] = r["m"]
    return out


def _fitting(patterns: list[int]) -> list[int]:
    """For each set of known pairs of a window (bit 2j: places j and j+1, bit 2j+1: j and j+2) the numbers of the patterns that fit, as bits."""
    needs = []
    for m in patterns:
        closed = lambda j: j < WINDOW and not m >> j & 1
        needs.append(sum(1 << (2 * j + gap - 1) for j in range(WINDOW) for gap in (1, 2) if closed(j) and closed(j + gap)))
    return [sum(1 << i for i, need in enumerate(needs) if need & ~known == 0) for known in range(4 ** (WINDOW - 1))]


def document_windows(docs: DataFrame, key: str, text: str, patterns: list[int], bitmap: list[int]) -> DataFrame:
    """(key, pos, n, open, hash, words, codes): the windows of documents that can match, for each pattern of open places that fits."""
    bits = F.array(*[F.lit(x).cast("long") for x in bitmap])
    fitting = F.array(*[F.lit(x) for x in _fitting(patterns)])
    plain = 1 << patterns.index(0)

    def test(pair: Column) -> Column:
        word = F.shiftrightunsigned(pair, 6).bitwiseAND(len(bitmap) - 1).cast("int")
        return F.getbit(F.get(bits, word), pair.bitwiseAND(63).cast("int")).cast("int")

    def known(codes: Column) -> Column:
        return F.transform(codes, lambda c, i: test(_pair(c, F.get(codes, i + 1), 1)) + 2 * test(_pair(c, F.get(codes, i + 2), 2)))

    def candidates(words: Column, codes: Column, flags: Column) -> Column:
        # the last pair of the last place reaches beyond the window and is asked for by no pattern
        seen = lambda i: sum((F.get(flags, i + j) * 4 ** j for j in range(1, WINDOW - 1)), F.get(flags, i))
        whole = F.filter(F.transform(_starts(words), lambda i: F.struct(i.alias("pos"), F.get(fitting, seen(i)).alias("fits"))), lambda x: x["fits"] != 0)
        short = F.array(F.struct(F.lit(0).alias("pos"), F.lit(plain).alias("fits")))
        found = F.when(F.size(words) >= WINDOW, whole).when(F.size(words) > 0, short)
        cut = lambda c, x: F.slice(c, x["pos"] + 1, F.lit(WINDOW))
        return F.transform(found, lambda x: F.struct(x["pos"].alias("pos"), x["fits"].alias("fits"), cut(words, x).alias("words"), cut(codes, x).alias("codes")))

    found = _let(_tokens(F.coalesce(F.col(text), F.lit(""))), lambda words: _let(_codes(words), lambda codes: _let(known(codes), lambda flags: candidates(words, codes, flags))))
    rows = docs.select(key, F.explode(found).alias("w_")).select(key, "w_.*").withColumn("n", F.size("words"))
    each = F.filter(F.array(*[F.struct(F.lit(1 << i).alias("bit"), F.lit(m).alias("open")) for i, m in enumerate(patterns)]), lambda p: F.col("fits").bitwiseAND(p["bit"]) != 0)
    rows = rows.withColumn("open", F.explode(F.transform(each, lambda p: p["open"])))
    return rows.select(key, "pos", "n", "open", _window_hash(F.col("codes"), F.col("open"), F.col("n")).alias("hash"), "words", "codes")


def short_matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(key_, item_id): stretches between ends of sentences or lines that are a short item, word for word."""
    line = lambda words: F.concat_ws(" ", words)
    items = benchmark.filter("item_id is not null and text is not null").select("item_id", _tokens(F.col("text")).alias("t_"))
    items = items.filter(F.size("t_").between(1, WINDOW - 1)).select("item_id", line(F.col("t_")).alias("t_"))
    if items.limit(1).count() == 0:
        return docs.sparkSession.createDataFrame([], "key_ long, item_id long")
    longest = items.agg(F.max(F.length("t_"))).first()[0]
    stretches = docs.select("key_", F.explode(F.split("text", _EDGE)).alias("s_")).filter(F.length("s_").between(1, 4 * longest + 16))
    return stretches.select("key_", line(_tokens(F.col("s_"))).alias("t_")).join(items, "t_").select("key_", "item_id").distinct()


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(key_, item_id, pos, hash, slots, item_pos, item_slots, places, item_windows) of equal template windows."""
    own = checkpointed(item_windows(benchmark))
    patterns = sorted({0} | {r["open"] for r in own.select("open").distinct().collect()})  # at most 16
    bitmap = _bitmap(own)
    # a window that an item repeats stands for all its places
    items = own.groupBy("item_id", "hash").agg(
        F.min(F.struct("item_pos", "item_slots")).alias("s_"), F.collect_set("item_pos").alias("places")).select("item_id", "hash", "s_.*", "places")
    items = items.join(own.groupBy("item_id").agg(F.countDistinct("item_pos").alias("item_windows")), "item_id")
    size = items.agg(F.sum(F.octet_length("item_slots") + 8 * F.size("places") + 64).alias("weight"), F.count("*").alias("n")).first()
    small = (size["weight"] or 0) <= BROADCAST_BYTES and size["n"] <= BROADCAST_WINDOWS
    found = document_windows(docs, "key_", "text", patterns, bitmap)
    found = found.join(F.broadcast(items) if small else items, "hash")
    slots = _slots(F.col("words"), F.col("codes"), F.col("open"))
    return found.withColumn("slots", slots).drop("words", "codes", "open")


def consistent(matched: DataFrame) -> DataFrame:
    """``matched`` without the readings of windows whose slots break the one-to-one mapping of their document and item."""
    pair = ["key_", "item_id", "diag"]
    matched = matched.withColumn("diag", F.col("pos") - F.col("item_pos"))
    # equal templates have as many slots on either side
    slot = matched.filter("item_slots <> ''").select(*pair, "pos", "hash", F.explode(F.arrays_zip(
        F.split("item_slots", _SEP).alias("item"), F.split("slots", _SEP).alias("doc"))).alias("z"))
    slot = slot.select(*pair, "pos", "hash", F.col("z.item").alias("item"), F.col("z.doc").alias("doc"))
    votes = slot.drop("hash").distinct().groupBy(*pair, "item", "doc").agg(F.count("*").alias("n"))
    # a value keeps the counterpart seen most often; a counterpart taken by another value breaks
    by_item = votes.groupBy(*pair, "item").agg(F.max(F.struct("n", "doc")).alias("m")).select(*pair, "item", F.col("m.doc").alias("doc"), F.col("m.n").alias("n"))
    chosen = by_item.groupBy(*pair, "doc").agg(F.max(F.struct("n", "item")).alias("m")).select(*pair, F.col("m.item").alias("item"), "doc", F.lit(True).alias("good"))
    broken = slot.join(chosen, [*pair, "item", "doc"], "left").filter("good is null").select(*pair, "pos", "hash").distinct()
    return matched.join(broken, [*pair, "pos", "hash"], "left_anti")


def _keyed(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with ``key_``, which rows of equal doc_id and text share."""
    return docs.withColumn("key_", F.xxhash64(F.col("doc_id").cast("string"), F.coalesce("text", F.lit(""))))


def leaks(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, run: int = RUN) -> DataFrame:
    """(key_, item_id, share, run) of contaminated rows and the items that they hold."""
    docs = _keyed(docs).select("key_", "text")
    # the few matches are read several times; the documents only once
    good = consistent(checkpointed(matches(docs, benchmark)))
    order = W.partitionBy("key_", "item_id", "diag").orderBy("pos")
    island = good.select("key_", "item_id", "diag", "pos", "n").distinct().withColumn("isle", F.col("pos") - F.row_number().over(order))
    length = island.groupBy("key_", "item_id", "diag", "isle").agg((F.count("*") + F.max("n") - 1).alias("n"))
    length = length.groupBy("key_", "item_id").agg(F.max("n").alias("run"))
    cover = good.select("key_", "item_id", "item_windows", F.explode("places").alias("place")).groupBy("key_", "item_id").agg(
        (F.countDistinct("place") / F.max("item_windows")).alias("share"))
    found = cover.join(length, ["key_", "item_id"]).filter((F.col("share") >= share) | (F.col("run") >= run))
    short = short_matches(docs.filter("text is not null"), benchmark).select("key_", "item_id", F.lit(1.0).alias("share"), F.lit(0).cast("long").alias("run"))
    return found.unionByName(short).groupBy("key_", "item_id").agg(F.max("share").alias("share"), F.max("run").alias("run"))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, contaminated, n_items, item_id (best), share, run."""
    found = leaks(docs, benchmark)
    best = found.groupBy("key_").agg(F.count("*").alias("n_items"), F.max(F.struct("share", "run", -F.col("item_id"))).alias("b"))
    best = best.select("key_", "n_items", (-F.col("b.col3")).alias("item_id"), F.col("b.share").alias("share"), F.col("b.run").alias("run"))
    out = _keyed(docs).select("key_", "doc_id").join(best, "key_", "left")
    zero = F.lit(0).cast("long")
    return out.select("doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", zero).alias("n_items"), "item_id",
                      F.coalesce("share", F.lit(0.0)).alias("share"), F.coalesce("run", zero).alias("run"))


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with their own columns."""
    return _keyed(docs).join(leaks(docs, benchmark).select("key_").distinct(), "key_", "left_anti").select(*docs.columns)
