"""Personal data replaced by keyed surrogates of the same kind.

Entities are found by patterns: e-mail addresses, card and phone numbers, social security numbers,
IP addresses, hexadecimal secrets, given names and surnames (Latin or Cyrillic). Each entity has a
canonical form (digits of a number, lower case of an address), and one surrogate per kind and
canonical form for the whole corpus, so a person or number stays the same wherever it occurs and
however it is written. The surrogate is drawn from a keyed SHA-256 and put into the format of
the occurrence: separators, number of digits, length, case, check digit of a card, gender and script
of a name. Two values that draw one surrogate, or a surrogate that is some real value, are
found by a join over the distinct values; all but the smallest draw again until none collides.

DataFrame operations only. Texts without a digit, an @ or a known name pass through; only the
others are joined with their replacements.

Defined cases: null and empty texts stay as they are; repeated rows are replaced alike; text
between entities is unchanged to the byte; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from regionloom.llm.suffix_dedup import numbered
from regionloom.session import checkpointed

KEY = "surrogates-1"
ROUNDS = 50

# fixed values: given names by gender and script, and titles, that mark a person
GIVEN_F = ["Alice", "Anna", "Barbara", "Carol", "Clara", "Elena", "Emily", "Emma", "Jane", "Julia", "Laura", "Linda", "Lisa", "Lucia",
           "Maria", "Marie", "Mary", "Nancy", "Olivia", "Sarah", "Sofia", "Susan"]
GIVEN_M = ["Adam", "Andrew", "Brian", "Carlos", "Charles", "Daniel", "David", "George", "Hans", "James", "John", "Joseph", "Juan", "Karl",
           "Mark", "Michael", "Paul", "Peter", "Pierre", "Robert", "Thomas", "William"]
GIVEN_F_CYR = ["Анна", "Екатерина", "Елена", "Ирина", "Мария", "Наталья", "Ольга", "Татьяна"]
GIVEN_M_CYR = ["Александр", "Алексей", "Андрей", "Дмитрий", "Иван", "Михаил", "Николай", "Сергей"]
TITLES = ["Mr", "Mrs", "Ms", "Dr", "Prof"]
SYLLABLES = ["ba", "de", "fi", "go", "ha", "ke", "li", "mo", "na", "pe", "ri", "so", "ta", "ve", "wi", "zo"]
SYLLABLES_CYR = ["ба", "де", "фи", "го", "ха", "ке", "ли", "мо", "на", "пе", "ри", "со", "та", "ве", "ви", "зо"]

_NAMES = "|".join(GIVEN_F + GIVEN_M + GIVEN_F_CYR + GIVEN_M_CYR)
_EMAIL = r"\b[A-Za-z0-9_%+-][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,4}\.[A-Za-z]{2,12}\b"
_SECRET = r"\b(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})\b"
_IP = r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b"
_CARD = r"\b[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}\b"
_SSN = r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"
_PHONE = r"(?:\+[0-9]{1,3}[ .-]?|\b)\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}\b"
_GIVEN = rf"(?=\p{{Lu}})(?<![\p{{L}}\p{{N}}])(?:{_NAMES})(?![\p{{L}}\p{{N}}])"
_SURNAME = rf"(?=\p{{Lu}}\p{{Ll}})(?<= )(?:(?<=(?<![\p{{L}}])(?:{_NAMES}) )|(?<=(?<![\p{{L}}])(?:{'|'.join(TITLES)})\.? ))\p{{Lu}}\p{{Ll}}+(?![\p{{L}}])"
PATTERN = f"{_EMAIL}|{_SECRET}|{_CARD.replace(chr(92) + '1', '[ -]?').replace('([ -]?)', '[ -]?')}|{_SSN}|{_PHONE}|{_IP}|{_GIVEN}|{_SURNAME}"
# a look ahead for a capital lets nearly every place of a text fail at once
QUICK = rf"[0-9@]|(?=\p{{Lu}})(?<![\p{{L}}\p{{N}}])(?:{_NAMES}|(?:{'|'.join(TITLES)})\.? \p{{Lu}})"


def _kind(value: Column) -> Column:
    script = F.when(value.rlike(r"\p{IsCyrillic}"), "cyr").otherwise("lat")
    return (F.when(value.contains("@"), "email").when(value.rlike("^[0-9A-Fa-f]{32,64}$") & ~value.rlike("^[0-9]{1,19}$"), "secret")
            .when(value.rlike("^" + _IP + "$"), "ip").when(value.rlike("^" + _SSN + "$"), "ssn")
            .when(value.rlike(r"^[0-9](?:[ -]?[0-9]){12,18}$"), "card").when(value.rlike("[0-9]"), "phone")
            .when(value.isin(GIVEN_F + GIVEN_F_CYR), F.concat(F.lit("given_f_"), script))
            .when(value.isin(GIVEN_M + GIVEN_M_CYR), F.concat(F.lit("given_m_"), script)).otherwise(F.concat(F.lit("surname_"), script)))


def _canonical(kind: Column, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    # a phone number is the same with and without its country code, which it keeps
    return (F.when(kind == "phone", F.right(digits, F.lit(10))).when(kind.isin("card", "ssn"), digits)
            .when(kind.isin("email", "secret"), F.lower(value)).otherwise(value))


def _nibble(stream: Column, i) -> Column:
    return F.conv(F.substring(stream, i, 1), 16, 10).cast("int") if isinstance(i, int) else F.conv(stream.substr(i, F.lit(1)), 16, 10).cast("int")


def _syllables(stream: Column, start: int, n: int, table: list[str]) -> list[Column]:
    names = F.array(*(F.lit(s) for s in table))
    return [F.element_at(names, _nibble(stream, start + i) + 1) for i in range(n)]


def _luhn_total(digits: Column, shift: Column) -> Column:
    """Luhn sum of a digit string whose last digit is doubled if ``shift`` is 1."""
    pairs = F.transform(F.filter(F.split(digits, ""), lambda c: c != ""), lambda c, i: F.struct(c.cast("int").alias("d"), ((F.length(digits) - 1 - i + shift) % 2).alias("two")))
    value = lambda p: F.when(p["two"] == 1, p["d"] * 2 - F.when(p["d"] > 4, 9).otherwise(0)).otherwise(p["d"])
    return F.aggregate(pairs, F.lit(0), lambda acc, p: acc + value(p))


def _draw(kind: Column, canon: Column, attempt: Column, key: str) -> Column:
    """The surrogate of a canonical form: a function of the key, the kind, the form and the number of the try."""
    seed = F.concat_ws("\u0001", F.lit(key), kind, canon, attempt.cast("string"))
    stream = F.concat(F.sha2(seed, 256), F.sha2(F.concat(seed, F.lit("+")), 256))
    # 15 hexadecimal digits at a time give 16 even decimal ones
    decimal = F.concat(*(F.substring(F.lpad(F.conv(F.substring(stream, 1 + 15 * i, 15), 16, 10), 19, "0"), 4, 16) for i in range(4)))
    digits = F.substring(decimal, 1, 64).substr(F.lit(1), F.length(canon))
    # a card keeps its first digit, and a valid check digit stays valid
    body = F.concat(F.substring(canon, 1, 1), digits.substr(F.lit(2), F.length(canon) - 2))
    check = F.pmod(10 - F.pmod(_luhn_total(body, F.lit(1)), F.lit(10)), F.lit(10)).cast("string")
    card = F.when(F.pmod(_luhn_total(canon, F.lit(0)), F.lit(10)) == 0, F.concat(body, check)).otherwise(
        F.concat(body, digits.substr(F.length(canon), F.lit(1))))
    local, domain = F.split_part(canon, F.lit("@"), F.lit(1)), F.split_part(canon, F.lit("@"), F.lit(2))
    letters = F.translate(stream, "0123456789", "ghijkmnopq")
    swapped = F.array_join(F.transform(F.filter(F.split(local, ""), lambda c: c != ""), lambda c, i: (
        F.when(c.between("0", "9"), decimal.substr(i + 1, F.lit(1))).when(c.between("a", "z"), letters.substr(i + 1, F.lit(1))).otherwise(c))), "")
    # short local parts leave too few choices: later tries add letters
    email = F.concat(swapped, F.when(attempt > 2, letters.substr(F.lit(70), attempt)).otherwise(""), F.lit("@"),
                     F.substring(F.translate(F.sha2(F.concat(F.lit(key), domain), 256), "0123456789", "ghijkmnopq"), 1, 8), F.lit(".example."),
                     F.regexp_extract(domain, r"([a-z]+)$", 1))
    octets = [(F.conv(F.substring(stream, 1 + 2 * i, 2), 16, 10).cast("int") % 254 + 1).cast("string") for i in range(4)]
    out = F.when(kind == "email", email).when(kind == "secret", stream.substr(F.lit(1), F.length(canon))).when(kind == "ip", F.concat_ws(".", *octets))
    out = out.when(kind == "card", card).when(kind.isin("phone", "ssn"), digits)
    for script, table, end_f, end_m in (("lat", SYLLABLES, "a", "n"), ("cyr", SYLLABLES_CYR, "я", "н")):
        longer = F.when(attempt > 2, F.concat(*_syllables(stream, 40, 3, table))).otherwise("")
        two = F.concat(*_syllables(stream, 1, 2, table), longer)
        out = out.when(kind == "given_f_" + script, F.initcap(F.concat(two, F.lit(end_f)))).when(kind == "given_m_" + script, F.initcap(F.concat(two, F.lit(end_m))))
        out = out.when(kind == "surname_" + script, F.initcap(F.concat(*_syllables(stream, 9, 3, table), longer)))
    return out


def _render(kind: Column, value: Column, new: Column) -> Column:
    """The surrogate in the format of the occurrence."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    new = F.when(kind == "phone", F.concat(digits.substr(F.lit(1), F.length(digits) - F.length(new)), new)).otherwise(new)
    walked = F.aggregate(F.filter(F.split(value, ""), lambda c: c != ""), F.struct(F.lit("").alias("s"), F.lit(1).alias("i")), lambda acc, c: (
        F.when(c.between("0", "9"), F.struct(F.concat(acc["s"], new.substr(acc["i"], F.lit(1))).alias("s"), (acc["i"] + 1).alias("i")))
        .otherwise(F.struct(F.concat(acc["s"], c).alias("s"), acc["i"].alias("i")))), lambda acc: acc["s"])
    return (F.when(kind.isin("card", "phone", "ssn"), walked)
            .when(kind.isin("email", "secret") & (value == F.upper(value)) & (value != F.lower(value)), F.upper(new)).otherwise(new))


def surrogates(values: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, canon, new) for the distinct (kind, canon) of ``values``; no two of a kind share ``new``."""
    found = checkpointed(values.select("kind", "canon").distinct().withColumn("attempt", F.lit(0)).withColumn("new", _draw(F.col("kind"), F.col("canon"), F.lit(0), key)))
    for _ in range(ROUNDS):
        owners = found.groupBy("kind", "new").agg(F.count("*").alias("n"), F.min("canon").alias("first"))
        real = found.select("kind", F.col("canon").alias("new"), F.lit(True).alias("real"))
        clash = owners.join(real, ["kind", "new"], "left").filter("n > 1 or real").select("kind", "new", "first", F.coalesce("real", F.lit(False)).alias("real"))
        again = found.join(clash, ["kind", "new"], "left").withColumn("redo", F.col("first").isNotNull() & (F.col("real") | (F.col("canon") != F.col("first"))))
        if again.filter("redo").limit(1).count() == 0:
            return found.drop("attempt")
        attempt = F.when(F.col("redo"), F.col("attempt") + 1).otherwise(F.col("attempt"))
        found = checkpointed(again.withColumn("attempt", attempt).withColumn(
            "new", F.when(F.col("redo"), _draw(F.col("kind"), F.col("canon"), F.col("attempt"), key)).otherwise(F.col("new"))).select("kind", "canon", "attempt", "new"))
    raise RuntimeError("the surrogates of some kind keep colliding: its values leave no room for distinct ones")


def entities(docs: DataFrame) -> DataFrame:
    """(id, place, value, kind, canon) of every entity of documents (id, text)."""
    found = docs.filter(F.col("text").rlike(QUICK)).select("id", F.posexplode(F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))).alias("place", "value"))
    return found.withColumn("kind", _kind(F.col("value"))).withColumn("canon", _canonical(F.col("kind"), F.col("value")))


def pseudonymised(docs: DataFrame, key: str = KEY) -> DataFrame:
    """doc_id, n_entities, kinds and the text with surrogates, per row of ``docs``."""
    rows = numbered(docs)
    found = checkpointed(entities(rows))
    table = surrogates(found, key)
    # copies of a value meet its one surrogate; adaptive execution splits a value that many texts share
    new = found.join(table.hint("merge"), ["kind", "canon"]).select("id", "place", "kind", _render(F.col("kind"), F.col("value"), F.col("new")).alias("new"))
    per_row = new.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("place", "new"))).alias("swaps"), F.sort_array(F.collect_set("kind")).alias("kinds"))
    busy = F.coalesce(F.col("text").rlike(QUICK), F.lit(False))
    joined = rows.filter(busy).join(per_row.hint("merge"), "id", "left")
    between = F.split("text", PATTERN, -1)
    woven = F.array_join(F.flatten(F.zip_with(between, F.col("swaps.new"), lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    touched = joined.select("doc_id", F.coalesce(F.size("swaps"), F.lit(0)).alias("n"), F.col("kinds"), F.when(F.col("swaps").isNull(), F.col("text")).otherwise(woven).alias("text"))
    same = rows.filter(~busy).select("doc_id", F.lit(0).alias("n"), F.array().cast("array<string>").alias("kinds"), "text")
    out = touched.withColumn("n", F.when(F.col("kinds").isNull(), 0).otherwise(F.col("n"))).withColumn("kinds", F.coalesce("kinds", F.array().cast("array<string>"))).union(same)
    return out.select("doc_id", F.col("n").cast("long").alias("n_entities"), "kinds", "text")
