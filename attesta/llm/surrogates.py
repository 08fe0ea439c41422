"""Personal data replaced by keyed surrogates of the same type, format, script and gender."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions.lineage import cut
from attesta.llm.common import broadcast_if_small, let, unused

#: Titles and given names by which people and their gender are told.
TITLES_MALE = "Mr Mister Sir Herr Monsieur Señor Don".split()
TITLES_FEMALE = "Mrs Ms Miss Madam Frau Madame Mademoiselle Señora Señorita Doña".split()
GIVEN_MALE = "James John Robert Michael William David Richard Thomas Hans Peter Klaus Jürgen Wolfgang Pierre Jean Jacques Louis Carlos José Juan Miguel Antonio Иван Сергей Алексей Дмитрий Андрей".split()
GIVEN_FEMALE = "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Sarah Anna Greta Ursula Ingrid Marie Claire Sophie Camille Isabelle María Carmen Lucía Elena Teresa Мария Анна Елена Ольга Наталья".split()

WORD = r"\p{Lu}[\p{L}'’-]*\p{L}"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)",
    "card": r"(?<![\w-])\d{4}(?:[ -]?\d{4}){3}(?![\w]|-\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w]|-\d)",
    "phone": r"(?<![\w])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\w)|(?<!\w)\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\w)|(?<![\w.-])(?:1[-. ])?\d{3}[.-]\d{3}[.-]\d{4}(?!\w)",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,6}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "person": rf"(?<!\p{{L}})(?:(?:{'|'.join(TITLES_MALE + TITLES_FEMALE)})\.? {WORD}(?: {WORD})?|(?:{'|'.join(GIVEN_MALE + GIVEN_FEMALE)}) {WORD})",
}
#: All of them, each behind a glance at what it can begin with, as one pass over every text has to be cheap.
BEGINS = {"email": "(?<![A-Za-z0-9._%+-])", "ip": r"(?=\d)", "card": r"(?=\d)", "ssn": r"(?=\d)", "phone": r"(?=[+(\d])", "iban": r"(?=[A-Z]{2}\d)", "person": r"(?=\p{Lu})"}
ANY = "|".join(f"{BEGINS[k]}(?:{p})" for k, p in PATTERNS.items())

#: A round leaves the share of values whose surrogates collide, so this is only met where a format has no room left.
ATTEMPTS = 50

#: About a hundred bytes each.
BROADCAST_ENTITIES = 500_000

#: Syllables of made-up names, and the endings that tell gender.
LATIN = ("ba da fe go ka le mi no pa ra se ti vo wen lor mar nel sten bri dal", {"m": "n r s o", "f": "a ina ia elle", "s": "er son ler by"})
CYRILLIC = ("ба да фе го ка ле ми но па ра се ти во вен лор мар", {"m": "н р ил ей", "f": "а ина ия ья", "s": "ов ин ский ко"})
LETTERS = ("abcdefghijklmnopqrstuvwxyz", "абвгдежзиклмнопрстуфхцчшэюя", "αβγδεζηθικλμνξοπρστυφχψω")


def detected(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(ANY), F.lit(0))


def _kind(found: Column) -> Column:
    out = F
    for kind, pattern in PATTERNS.items():
        out = out.when(found.rlike(f"^(?:{pattern})$"), kind)
    return out.otherwise("person")


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, r"\D", "")


def units(found: Column, kind: Column) -> Column:
    """The parts of a found entity that corefer: struct(type, value). Forms of one number or address have one value.

    A person is a given name and a surname, each of which keeps its surrogate wherever it occurs; the gender is that
    of a known given name, else of the title.
    """
    one = lambda t, v: F.struct(F.lit(t).alias("type"), v.alias("value"))
    words = F.split(F.regexp_replace(found, rf"^(?:{'|'.join(TITLES_MALE + TITLES_FEMALE)})\.? ", ""), " ")
    gender = lambda first: (
        F.when(first.isin(*GIVEN_FEMALE), "f").when(first.isin(*GIVEN_MALE), "m")
        .when(found.rlike(rf"^(?:{'|'.join(TITLES_FEMALE)})\.? "), "f").otherwise("m")
    )
    person = let(
        words,
        lambda w: F.when(
            (F.size(w) > 1) | w[0].isin(*GIVEN_MALE, *GIVEN_FEMALE),
            F.concat(
                F.array(F.struct(F.concat(F.lit("given_"), gender(w[0])).alias("type"), F.lower(w[0]).alias("value"))),
                F.transform(F.slice(w, 2, 8), lambda x: F.struct(F.lit("surname").alias("type"), F.lower(x).alias("value"))),
            ),
        ).otherwise(F.array(one("surname", F.lower(w[0])))),
    )
    return (
        F.when(kind == "email", F.array(one("email", F.lower(found))))
        .when(kind == "ip", F.array(one("ip", found)))
        .when(kind == "card", F.array(one("card", _digits(found))))
        .when(kind == "ssn", F.array(one("ssn", _digits(found))))
        .when(kind == "phone", F.array(one("phone", _digits(found))))
        .when(kind == "iban", F.array(one("iban", F.replace(found, F.lit(" "), F.lit("")))))
        .otherwise(person)
    )


def _number(seed: Column, i: Column | int, below: int) -> Column:
    return F.pmod(F.xxhash64(seed, F.lit(i) if isinstance(i, int) else i), F.lit(below)).cast("int")


def _pick(text: str, seed: Column, i: int) -> Column:
    parts = text.split()
    return F.get(F.array(*map(F.lit, parts)), _number(seed, i, len(parts)))


def _mapped(value: Column, seed: Column) -> Column:
    """Every digit becomes a digit and every letter a letter of its script, in lower case; the rest stays."""

    def char(c: Column, i: Column) -> Column:
        out = F.when(c.rlike("[0-9]"), _number(seed, i, 10).cast("string"))
        for script in LETTERS:
            out = out.when(F.instr(F.lit(script), c) > 0, F.substring(F.lit(script), _number(seed, i, len(script)) + 1, F.lit(1)))
        return out.when(c.rlike(r"\p{IsHan}"), F.substring(F.lit("王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗"), _number(seed, i, 20) + 1, F.lit(1))).when(
            c.rlike(r"\p{L}"), F.substring(F.lit(LETTERS[0]), _number(seed, i, 26) + 1, F.lit(1))
        ).otherwise(c)

    return F.array_join(F.transform(F.split(value, ""), char), "")


def _luhn(digits: Column) -> Column:
    """Sum of the Luhn check; a multiple of ten if the last digit is right."""
    n = F.length(digits)

    def weight(c: Column, i: Column) -> Column:
        v = c.cast("int")
        return F.when((n - i) % 2 == 0, F.when(v > 4, 2 * v - 9).otherwise(2 * v)).otherwise(v)

    return F.aggregate(F.transform(F.split(digits, ""), weight), F.lit(0), lambda a, x: a + x)


def made(kind: Column, value: Column, seed: Column) -> Column:
    """The surrogate of a value of the given type; `seed` is the keyed digest of both and of the attempt."""
    mapped = _mapped(value, seed)
    country = F.greatest(F.length(value) - 10, F.lit(0))
    phone = F.concat(F.expr("substring(value, 1, greatest(length(value) - 10, 0))"), F.substring(mapped, country + 1, F.length(value)))
    first = F.concat(F.substring(value, F.lit(1), F.lit(1)), F.substring(mapped, F.lit(2), F.length(value) - 2))
    checked = let(F.concat(first, F.lit("0")), lambda x: F.concat(F.expr("''"), F.substring(x, F.lit(1), F.length(x) - 1), F.pmod(10 - _luhn(x), F.lit(10)).cast("string")))
    card = F.when(_luhn(value) % 10 == 0, checked).otherwise(F.concat(first, F.right(mapped, F.lit(1))))
    ip = F.concat_ws(".", *[(_number(seed, i, 254) + 1).cast("string") for i in range(4)])
    domain = F.split_part(value, F.lit("@"), F.lit(-1))
    email = F.concat(_mapped(F.split_part(value, F.lit("@"), F.lit(1)), seed), F.lit("@"), _mapped(F.regexp_extract(domain, r"^(.*)\.[^.]*$", 1), seed), F.lit("."), F.regexp_extract(domain, r"([^.]*)$", 1))
    iban = F.concat(F.substring(value, F.lit(1), F.lit(2)), F.substring(F.upper(_mapped(F.lower(value), seed)), F.lit(3), F.length(value)))

    def name(role: str) -> Column:
        def of(script: tuple) -> Column:
            return F.concat(_pick(script[0], seed, 1), _pick(script[0], seed, 2), _pick(script[0], seed, 3), _pick(script[1][role], seed, 4))

        return F.when(value.rlike(r"\p{IsCyrillic}"), of(CYRILLIC)).when(value.rlike(r"\p{IsLatin}"), of(LATIN)).otherwise(mapped)

    return (
        F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", card).when(kind == "phone", phone)
        .when(kind == "iban", iban).when(kind == "given_m", name("m")).when(kind == "given_f", name("f")).when(kind == "surname", name("s")).otherwise(mapped)
    )


def surrogate_table(values: DataFrame, key: str) -> DataFrame:
    """(type, value, surrogate) of distinct (type, value): no surrogate stands for two values, and none is a real value.

    Each round makes the surrogates of the values that have none yet. One that equals a real value of its type or an
    earlier surrogate is refused; of equal new ones the least value keeps it. The others try again with the next
    attempt in their seed, until none is left; a format without room for all its values is an error. Given names of both genders count as one type here.
    """
    space = lambda c: F.regexp_replace(c, "^given_.$", "given")
    real = cut(values.select("type", "value").distinct())
    taken = real.select(space(F.col("type")).alias("space"), F.col("value").alias("surrogate"))
    settled, left, attempt = None, real, 0
    while True:
        seed = F.sha2(F.concat_ws("\u0000", F.lit(key), "type", "value", F.lit(str(attempt))), 256)
        new = left.withColumn("seed", seed).select("type", "value", made(F.col("type"), F.col("value"), F.col("seed")).alias("surrogate"))
        # Names are short: later attempts add letters.
        longer = F.when(F.col("type").rlike("^given|^surname"), F.concat("surrogate", F.lit("na" * attempt))).otherwise(F.col("surrogate"))
        new = cut(new.select("type", "value", longer.alias("surrogate"), space(F.col("type")).alias("space")))
        free = new.join(taken, ["space", "surrogate"], "left_anti")
        won = cut(free.groupBy("space", "surrogate").agg(F.min(F.struct("value", "type")).alias("by")).select(F.col("by.type").alias("type"), F.col("by.value").alias("value"), "surrogate", "space"))
        settled = won if settled is None else cut(settled.unionByName(won))
        left = cut(left.join(won, ["type", "value"], "left_anti"))
        if left.isEmpty():
            return settled.select("type", "value", "surrogate")
        taken = taken.unionByName(won.select("space", "surrogate"))
        attempt += 1
        if attempt == ATTEMPTS:
            raise ValueError("a format has fewer free surrogates than values")


def laid(found: Column, kind: Column, parts: Column) -> Column:
    """The surrogate in the form of the occurrence: its punctuation and spacing, its title, its letter case."""
    over = lambda keep: F.aggregate(
        F.split(found, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
        lambda a, c: F.when(c.rlike(keep), F.struct(F.concat(a["out"], F.substring(parts[0], a["at"], F.lit(1))).alias("out"), (a["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["at"].alias("at"))),
    )["out"]
    title = F.regexp_extract(found, rf"^((?:{'|'.join(TITLES_MALE + TITLES_FEMALE)})\.? )", 1)
    person = F.concat(title, F.array_join(F.transform(parts, lambda p: F.initcap(p)), " "))
    cased = F.when(found == F.upper(found), F.upper(parts[0])).otherwise(parts[0])
    return F.when(kind == "person", person).when(kind.isin("card", "ssn", "phone"), over("[0-9]")).when(kind == "iban", over("[A-Z0-9]")).when(kind == "email", cased).otherwise(parts[0])


def replace_private(docs: DataFrame, secret: str, key: str = "doc_id", text: str = "text", into: str = "private") -> DataFrame:
    """`docs` with surrogates in the text, and the struct array `into` of (kind, surrogate) in the order of the text.

    A column that is called `into` already is replaced.

    The surrogate of a value depends on `secret`, its type and the value, and on nothing else unless two collide; it is
    the same in every document. Texts without entities, empty texts, nulls and all other columns stay as they are;
    rows that repeat both key and text get equal results; an empty table gives an empty one. Texts are searched once;
    what was found is narrow, and a value found in very many documents is one row of the surrogate table. The lists of
    surrogates are broadcast to the texts if they hold BROADCAST_ENTITIES at most, else both are shuffled.
    """
    docs = docs.drop(into)
    k, h, k2, h2 = unused(docs, "key_of_text", "hash_of_text", "key_of_entities", "hash_of_entities")
    typed = docs.withColumn(h, F.xxhash64(F.col(text).cast("string")))
    entity = cut(typed.select(F.col(key).alias(k), F.col(h), F.posexplode(detected(F.col(text))).alias("pos", "found")))
    entity = entity.distinct().select(k, h, "pos", "found", _kind(F.col("found")).alias("kind"))
    parts = entity.select(k, h, "pos", "found", "kind", F.posexplode(units(F.col("found"), F.col("kind"))).alias("no", "unit")).select(k, h, "pos", "found", "kind", "no", "unit.type", "unit.value")
    named = surrogate_table(parts.select("type", "value"), secret)
    whole = parts.join(broadcast_if_small(named), ["type", "value"]).groupBy(k, h, "pos", "found", "kind").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("no", "surrogate"))), lambda x: x["surrogate"]).alias("parts")
    )
    listed = whole.select(k, h, "pos", "kind", laid(F.col("found"), F.col("kind"), F.col("parts")).alias("surrogate")).groupBy(k, h).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "kind", "surrogate"))), lambda x: F.struct(x["kind"].alias("kind"), x["surrogate"].alias("surrogate"))).alias(into)
    )
    listed = cut(listed.select(F.col(k).alias(k2), F.col(h).alias(h2), into))
    small = listed.agg(F.coalesce(F.sum(F.size(into)), F.lit(0))).first()[0] <= BROADCAST_ENTITIES
    joined = typed.join(F.broadcast(listed) if small else listed, F.col(key).eqNullSafe(F.col(k2)) & (F.col(h) == F.col(h2)), "left").drop(h, k2, h2)
    between = F.split(F.col(text), ANY, -1)
    woven = F.array_join(F.zip_with(between, F.col(f"{into}.surrogate"), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return joined.select(
        *[F.when(F.col(into).isNull(), F.col(c)).otherwise(woven).alias(c) if c == text else F.col(c) for c in docs.columns],
        F.coalesce(F.col(into), F.array().cast(listed.schema[into].dataType)).alias(into),
    )
