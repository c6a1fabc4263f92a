"""Surrogates for personal data, in DataFrame functions only.

One pattern finds entities; each is replaced by a keyed surrogate of the same type and format, drawn from
SHA-256 of key, type and normal form: the same entity gets the same surrogate everywhere (coreference), also
when it is written with other separators. Digits stay digits and letters letters of their case and script, a phone keeps its country
code, a card number its check-sum state, an address its top-level domain, an API key its prefix. A name keeps its title, hence gender, and its
script; its given and its family name are drawn apart, so that a family name has one surrogate with any title or given name before it.

Distinctness is checked on the table of distinct entities (of names, their parts): where two have one surrogate, or a surrogate is itself
an entity of the corpus, all but the first are drawn again with the next attempt, until none is left. From attempt ``LONGER_FROM`` on a surrogate
is one character or syllable longer with each, so a format that is full grows. What was drawn again goes back to the texts through a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

KEY = "nodeloom-surrogates-1"
#: Attempt from which surrogates get longer, and the rounds after which drawing fails loudly (only a format that can't grow could need as many).
LONGER_FROM = 12
MOST_ROUNDS = 400

_MALE = "Mr|Herr|Señor|Sr|Monsieur|господин"
_FEMALE = "Mrs|Ms|Miss|Frau|Señora|Sra|Señorita|Madame|Mme|Mademoiselle|госпожа"
#: Name pools by script and gender.
NAMES = {
    ("latin", "m"): "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leon Martin Nils Oscar Paul".split(),
    ("latin", "f"): "Alma Berta Clara Diana Elena Frida Greta Hanna Irene Julia Klara Laura Maria Nora Olga Paula".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Леонид Максим Никита Олег Павел Роман Семён Тимур".split(),
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Жанна Инна Ирина Лидия Мария Нина Ольга Полина Раиса Софья Тамара".split(),
}
SYLLABLES = {
    "latin": "ba be bi bo da de di do fa fe fi fo ga ge go ha he ho ka ke ki ko la le li lo ma me mi mo".split(),
    "cyrillic": "ба бе би бо да де ди до га ге го ва ве ви во ка ке ки ко ла ле ли ло ма ме ми мо на не но ра".split(),
}
#: Last letters of given names that are not from the pool, and the attempts that take one from the pool.
ENDINGS = {("latin", "m"): "n r s k d l".split(), ("latin", "f"): ["a"], ("cyrillic", "m"): "н р с к д л".split(), ("cyrillic", "f"): ["а"]}
POOL_ATTEMPTS = 2

_KEY_HEAD = "AKIA|sk-|gh[pousr]_|eyJ"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: What an entity looks like from a place that no letter or digit precedes. Each starts with what it needs, so most places fail at once.
PATTERNS = {
    "email": "[\\p{L}\\p{N}][\\p{L}\\p{N}._%+-]*+@(?:[\\p{L}\\p{N}-]++\\.)++[\\p{L}]{2,}",
    "ip": f"(?<!\\.)(?:{_OCTET}\\.){{3}}{_OCTET}(?!\\.?[0-9])",
    "iban": "[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\\p{L}\\p{N}])",
    "phone": "\\+[0-9]{1,3}[ .-]?(?:\\([0-9]{1,4}\\)[ .-]?)?[0-9]{2,5}(?:[ .-]?[0-9]{2,5}){1,4}(?![0-9])|\\(?[0-9]{3}\\)?[ .-][0-9]{3}[.-][0-9]{4}(?![0-9])",
    "ssn": "(?<!-)[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": "[0-9]{4}([ -]?)[0-9]{4}\\1[0-9]{4}\\1[0-9]{1,7}(?![0-9])",
    "secret": "(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+)(?![\\p{L}\\p{N}])",
    "key": "AKIA[0-9A-Z]{16}(?![\\p{L}\\p{N}])|sk-(?=[A-Za-z_-]*[0-9])[A-Za-z0-9_-]{20,}+|gh[pousr]_[A-Za-z0-9]{30,}+|eyJ[A-Za-z0-9_-]{5,}+(?:\\.[A-Za-z0-9_-]{5,}+){2}",
    "ipv6": "(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![:\\p{L}\\p{N}])|(?=[0-9A-Fa-f:]*[0-9])(?:[0-9A-Fa-f]{1,4}:){2,6}(?::[0-9A-Fa-f]{1,4}){1,6}(?![:\\p{L}\\p{N}])",
    "name": f"(?:{_MALE}|{_FEMALE})\\.? \\p{{Lu}}\\p{{Ll}}+(?:[ -]\\p{{Lu}}\\p{{Ll}}+)?",
}
ENTITY = "(?<![\\p{L}\\p{N}])(?:" + "|".join(f"(?:{p})" for p in PATTERNS.values()) + ")"


def _may_have(text: Column) -> Column:
    """Whether a text has what every entity has: a digit, an at sign, a title, the prefix of a key or a run of hexadecimal letters."""
    out = text.rlike("[0-9@]|[a-f]{32}|[A-F]{32}|AKIA|gh[pousr]_|eyJ")
    for title in f"{_MALE}|{_FEMALE}".split("|"):
        out = out | text.contains(title + " ") | text.contains(title + ". ")
    return out


def _kind(e: Column) -> Column:
    """Type of an entity that the pattern has found. Every test looks at its characters alone."""
    digits = F.regexp_replace(e, "[^0-9]", "")
    return (
        F.when(e.contains("@"), "email")
        .when(e.rlike("^[0-9]{1,3}(?:\\.[0-9]{1,3}){3}$"), "ip")
        .when(e.rlike(f"^(?:{_KEY_HEAD})[A-Za-z0-9_.-]*$"), "key")
        .when(e.contains(":"), "ipv6")
        .when(e.rlike("^[A-Z]{2}[0-9]{2} ?[A-Z0-9]"), F.when((F.length(e) >= 32) & e.rlike("^[0-9A-F]+$"), "secret").otherwise("iban"))
        .when(e.rlike("^\\p{L}.* ") , "name")
        .when(e.rlike("^\\+|^\\(?[0-9]{3}\\)?[ .-][0-9]{3}[.-][0-9]{4}$"), "phone")
        .when(e.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
        .when(e.rlike("^[0-9 -]+$") & (F.length(digits) < 32), "card")
        .otherwise("secret")
    )


def _normal(e: Column, kind: Column) -> Column:
    """Equal for spellings of one entity."""
    return F.when(kind.isin("phone", "ssn", "card"), F.regexp_replace(e, "[^0-9+]", "")).when(kind == "iban", F.replace(e, F.lit(" "), F.lit(""))).otherwise(F.lower(e))


def _hex(*parts: Column) -> Column:
    """128 hex digits."""
    one = F.concat_ws("\x1f", *parts)
    return F.concat(F.sha2(one, 256), F.sha2(F.concat(one, F.lit("\x1f+")), 256))


def _value(hexes: Column, i: Column) -> Column:
    """The i-th byte of the digest, around and around."""
    return F.conv(F.substring(hexes, (i % 64) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _of(letters: str, v: Column) -> Column:
    return F.substring(F.lit(letters), v % len(letters) + 1, F.lit(1))


_ABC, _CYR = "abcdefghijklmnopqrstuvwxyz", "абвгдежзиклмнопрстуфхцчшэюя"


def _like(text: Column, hexes: Column, hexadecimal: Column | None = None) -> Column:
    """Each letter and digit replaced by one of its kind; the n-th of them takes the n-th byte, so separators don't matter."""

    def one(c: Column, i: Column) -> Column:
        v = _value(hexes, i)
        plain = (
            F.when(c.rlike("[0-9]"), _of("0123456789", v))
            .when(c.rlike("[А-Яа-яЁё]"), F.when(c == F.upper(c), F.upper(_of(_CYR, v))).otherwise(_of(_CYR, v)))
            .when(c.rlike("\\p{L}"), F.when((c == F.upper(c)) & (c != F.lower(c)), F.upper(_of(_ABC, v))).otherwise(_of(_ABC, v)))
            .when(c.rlike("\\p{N}"), _of("0123456789", v))
            .otherwise(c)
        )
        if hexadecimal is None:
            return plain
        return F.when(hexadecimal, F.when(c.rlike("[A-F]"), _of("ABCDEF", v)).when(c.rlike("[a-f]"), _of("abcdef", v)).otherwise(plain)).otherwise(plain)

    bare = F.filter(F.split(F.regexp_replace(text, "[^\\p{L}\\p{N}]", ""), ""), lambda c: c != "")
    # what stands between letters and digits, by turns with them: there is one piece more
    return F.array_join(F.zip_with(F.split(text, "[\\p{L}\\p{N}]", -1), F.transform(bare, one), lambda gap, c: F.concat(gap, F.coalesce(c, F.lit("")))), "")


def _check_sum(digits: Column) -> Column:
    """Luhn sum mod 10."""
    n = F.length(digits)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: (F.substring(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1)))
    return F.aggregate(each, F.lit(0), lambda s, x: s + F.when(x > 9, x - 9).otherwise(x)) % 10


def _parts(e: Column, kind: Column) -> Column:
    """What is drawn of an entity: itself, or the given and family names of a name. Array of (kind, e, normal)."""
    bare = F.regexp_replace(e, "^\\p{L}+\\.? ", "")
    gender = F.when(e.rlike(f"^(?:{_FEMALE})[. ]"), "given f").otherwise("given m")
    given = F.filter(F.array(F.struct(gender.alias("kind"), F.regexp_extract(bare, "^(\\p{L}+) ", 1).alias("e"))), lambda x: x["e"] != "")
    families = F.transform(F.split(F.substring_index(bare, " ", -1), "-"), lambda x: F.struct(F.lit("family").alias("kind"), x.alias("e")))
    return F.transform(
        F.when(kind == "name", F.concat(given, families)).otherwise(F.array(F.struct(kind.alias("kind"), e.alias("e")))),
        lambda x: F.struct(x["kind"].alias("kind"), x["e"].alias("e"), _normal(x["e"], x["kind"]).alias("normal")),
    )


def _drawn(parts: Column, key: str, attempt_of) -> Column:
    """Array of (kind, e, normal) to the array of their surrogates. attempt_of: (kind, normal) to the attempt.

    The work goes in steps over the array, each of which adds fields, so that nothing is computed twice.
    """

    def digests(x: Column) -> Column:
        e, kind = x["e"], x["kind"]
        domain = F.when(kind == "email", F.substring_index(e, "@", -1)).otherwise("")
        last = F.substring_index(domain, ".", -1)
        stem = F.lower(F.substring(domain, F.lit(1), F.length(domain) - F.length(last)))
        head = (
            F.when(kind == "phone", F.regexp_extract(e, "^(\\+[0-9]{1,3}(?![0-9])|\\+[0-9]{1,2})?", 1))
            .when(kind == "iban", F.substring(e, 1, 2))
            .when(kind == "key", F.regexp_extract(e, f"^(?:{_KEY_HEAD})", 0))
            .otherwise("")
        )
        attempt = attempt_of(kind, x["normal"])
        fields = {"e": e, "kind": kind, "head": head, "stem": stem, "last": last, "attempt": attempt}
        fields["hexes"] = _hex(F.lit(key), kind, x["normal"], attempt.cast("string"))
        fields["domain_hexes"] = _hex(F.lit(key), F.lit("domain"), stem)
        return F.struct(*[v.alias(k) for k, v in fields.items()])

    def draw(x: Column) -> Column:
        e, kind = x["e"], x["kind"]
        longer = F.greatest(x["attempt"] - (LONGER_FROM - 1), F.lit(0))
        body = F.when(kind == "email", F.substring_index(e, "@", 1)).otherwise(F.substring(e, F.length(x["head"]) + 1, F.length(e)))
        body = F.concat(body, F.repeat(F.when(kind == "email", "a").otherwise("0"), F.when(kind == "ipv6", 0).otherwise(longer)))
        drawn = F.when(kind.isin("ip", "family", "given m", "given f"), "").otherwise(_like(body, x["hexes"], kind.isin("secret", "ipv6")))
        stem = F.when(kind == "email", _like(x["stem"], x["domain_hexes"])).otherwise("")
        return F.struct(*[x[k].alias(k) for k in ("e", "kind", "head", "last", "hexes", "attempt")], longer.alias("longer"), stem.alias("stem"), drawn.alias("drawn"))

    def compose(x: Column) -> Column:
        e, kind, hexes, drawn = x["e"], x["kind"], x["hexes"], x["drawn"]
        ip = F.concat_ws(".", *[(_value(hexes, F.lit(i)) % 254 + 1).cast("string") for i in range(4)])
        old, new = _check_sum(F.regexp_replace(e, "[^0-9]", "")), _check_sum(F.regexp_replace(drawn, "[^0-9]", ""))
        card = F.concat(F.substring(drawn, F.lit(1), F.length(drawn) - 1), F.pmod(F.substring(drawn, -1, 1).cast("int") + old - new, F.lit(10)).cast("string"))

        cyrillic, woman = e.rlike("\\p{IsCyrillic}"), kind == "given f"
        listed = lambda words: F.split(F.lit(" ".join(words)), " ")
        by_script = lambda of: F.when(cyrillic, of("cyrillic")).otherwise(of("latin"))
        by_gender = lambda table: by_script(lambda script: F.when(woman, listed(table[script, "f"])).otherwise(listed(table[script, "m"])))
        syllables = by_script(lambda script: listed(SYLLABLES[script]))
        n = x["longer"] + F.when(kind == "family", 4).otherwise(2)
        pick = lambda words, i: F.element_at(words, _value(hexes, i) % F.size(words) + 1)
        name = F.initcap(F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: pick(syllables, i)), ""))
        given = F.when(x["attempt"] < POOL_ATTEMPTS, pick(by_gender(NAMES), F.lit(0))).otherwise(F.concat(name, pick(by_gender(ENDINGS), F.lit(0))))
        return (
            F.when(kind == "email", F.concat(drawn, F.lit("@"), x["stem"], x["last"])).when(kind == "ip", ip).when(kind == "card", card)
            .when(kind == "family", name).when(kind.startswith("given"), given).otherwise(F.concat(x["head"], drawn))
        )

    return F.transform(F.transform(F.transform(parts, digests), draw), compose)


def _surrogates(entities: Column, key: str, attempt_of) -> Column:
    """Array of entities to the array of their surrogates."""
    step = F.transform(entities, lambda e: F.struct(e.alias("e"), _kind(e).alias("kind")))
    step = F.transform(step, lambda x: F.struct(x["e"].alias("e"), x["kind"].alias("kind"), _drawn(_parts(x["e"], x["kind"]), key, attempt_of).alias("new")))

    def put(x: Column) -> Column:
        names = F.when(x["e"].contains("-"), F.array_join(x["new"], "-")).otherwise(F.array_join(x["new"], " "))
        return F.when(x["kind"] == "name", F.concat(F.regexp_extract(x["e"], "^\\p{L}+\\.? ", 0), names)).otherwise(F.element_at(x["new"], 1))

    return F.transform(step, put)


def attempts_needed(entities: DataFrame, key: str = KEY) -> DataFrame:
    """Distinct (kind, normal, e) to (kind, normal, attempt) of those that can't keep attempt 0, so that surrogates are distinct and no entities themselves.

    Each round draws only what the round before has left; what is settled stays.
    """
    spark = entities.sparkSession
    real = entities.select("kind", F.col("normal").alias("drawn"))
    kept, left = [], entities
    for attempt in range(MOST_ROUNDS):
        drawn = F.element_at(_drawn(F.array(F.struct("kind", "e", "normal")), key, lambda *_, n=attempt: F.lit(n)), 1)
        now = left.select("kind", "normal", "e", _normal(drawn, F.col("kind")).alias("drawn"))
        now = now.withColumn("n", F.row_number().over(Window.partitionBy("kind", "drawn").orderBy("normal")))
        for taken in [real, *(x.select("kind", "drawn") for x in kept)]:
            mark = f"taken{len(now.columns)}"
            now = now.join(taken.withColumn(mark, F.lit(True)), ["kind", "drawn"], "left")
        again = F.col("n") > 1
        for c in now.columns:
            if c.startswith("taken"):
                again = again | F.col(c).isNotNull()
        now, _ = common.store(now.select("kind", "normal", "e", "drawn", F.lit(attempt).alias("attempt"), again.alias("again")), "drawn")
        kept.append(now.where(~F.col("again")))
        left = now.where("again").select("kind", "normal", "e")
        if left.isEmpty():
            break
    else:
        raise RuntimeError(f"surrogates are not distinct after {MOST_ROUNDS} rounds: a format has too few values")
    if len(kept) == 1:
        return spark.createDataFrame([], "kind string, normal string, attempt int")
    more = kept[1]
    for x in kept[2:]:
        more = more.unionByName(x)
    return common.store(more.select("kind", "normal", "attempt"), "attempts")[0]


def _found(text: Column) -> Column:
    return F.when(_may_have(text), F.regexp_extract_all(text, F.lit(ENTITY), 0)).otherwise(F.array().cast("array<string>"))


def replace_pii(docs: DataFrame, text_col: str = "text", key: str = KEY, count_col: str = "n_entities") -> DataFrame:
    """``docs`` with surrogates in ``text_col`` and a column ``count_col`` (int) more, their number in the text; a column of that name is an error.

    A null text stays null with 0 entities. Every row is kept, repeated ones alike. Other columns stay as they are, whatever their names.
    """
    if count_col in docs.columns:
        raise ValueError(f"there is a column {count_col}: name another count_col")
    text = F.col(text_col)
    each = docs.select(F.explode(F.array_distinct(_found(text))).alias("e"))
    each = each.groupBy("e").agg(F.lit(1).alias("one")).select("e", _kind(F.col("e")).alias("kind"))
    each = each.select(F.explode(_parts(F.col("e"), F.col("kind"))).alias("x")).groupBy("x.kind", "x.normal").agg(F.min("x.e").alias("e"))
    each, _ = common.store(each, "entities")
    more = attempts_needed(each, key)
    tag = lambda kind, normal: F.concat(kind, F.lit("\x1f"), normal)
    listed = None
    if not more.isEmpty():
        own = docs.select(F.md5(text).alias("__md5"), F.explode(F.array_distinct(_found(text))).alias("e")).withColumn("kind", _kind(F.col("e")))
        own = own.select("__md5", F.explode(_parts(F.col("e"), F.col("kind"))).alias("x")).select("__md5", "x.kind", "x.normal")
        own = own.join(more, ["kind", "normal"]).groupBy("__md5", "kind", "normal").agg(F.min("attempt").alias("attempt"))
        own = own.groupBy("__md5").agg(F.map_from_entries(F.collect_list(F.struct(tag(F.col("kind"), F.col("normal")), "attempt"))).alias("__attempts"))
        own, _ = common.store(own, "attempts")  # its size is known when the join is planned
        docs = docs.withColumn("__md5", F.md5(text)).join(own, "__md5", "left")
        listed = F.col("__attempts")

    def attempt_of(kind: Column, normal: Column) -> Column:
        return F.lit(0) if listed is None else F.coalesce(F.try_element_at(listed, tag(kind, normal)), F.lit(0))

    entities = _found(text)
    plain = F.split(text, ENTITY, -1)
    # plain texts and surrogates by turns: there is one plain text more
    woven = F.array_join(F.zip_with(plain, _surrogates(F.col("__found"), key, attempt_of), lambda p, s: F.concat(p, F.coalesce(s, F.lit("")))), "")
    names = [c for c in docs.columns if c not in ("__md5", "__attempts")]
    out = docs.withColumn("__found", entities)
    new = F.when(F.size("__found") > 0, woven).otherwise(text)
    return out.select(*[new.alias(c) if c == text_col else F.col(c) for c in names], F.size("__found").alias(count_col))


def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_pii(common.table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE = None
