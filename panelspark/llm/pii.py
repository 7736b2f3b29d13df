"""Personal data and secrets replaced by keyed surrogates, with DataFrame functions alone.

One pattern finds what may be private, once for each text; the result is written with the rows. What is found gets a type (numbers that fail their check
sum get none and stay), and a canonical form without the separators and the case of its spelling. The surrogate comes
from a keyed digest of type, canonical form and a person's gender, so all spellings of an entity have one surrogate (coreference), in the
spelling's own format: digit for digit, letter for letter of the same script and case, separators where they were; card
numbers keep a valid check digit, addresses valid numbers, titles stay and choose names of their gender and script.

Distinct entities of the whole corpus are checked: if two of a type would share a surrogate, or one's surrogate is another's
real value, all but the smallest take the digest of a further attempt, until none collide. Persons' names get a syllable more with each
attempt; the other types keep their format for WIDE_AFTER attempts, and then get a letter or digit more with each (an IPv4 address a
port), so there are enough surrogates however many entities there are, even if the real ones are all that the format has.

Defined results: null texts stay null and have no entities; texts without entities, empty ones too, are unchanged to the character; all
columns of the input are kept, and an input column with a name of the added ones is an error that says so; repeated
rows are treated alike, and so are rows whose key is null or shared; an empty table gives an empty result.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.llm.common import materialize

#: Attempts that keep an entity's own length; the domains are large, so few entities need as many.
WIDE_AFTER = 4
#: The setting that holds the key of the surrogates. Where it is unset the application draws a key of its own.
KEY_CONF = "spark.panelspark.pii.key"

_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_TITLE = {"m": ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Г-н", "Господин"), "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Г-жа", "Госпожа")}
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}_%+-][\p{L}\p{N}._%+-]*+@[\p{L}\p{N}](?:[\p{L}\p{N}-]*+\.)+\p{L}{2,}",
    "secret": r"(?<![\p{L}\p{N}])(?:(?i:token|password|passwd|pwd|secret|api[_-]?key|access[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9+/_-]{10,}={0,2}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|sk-[A-Za-z0-9]{20,})",
    "ipv4": rf"(?<![\p{{N}}.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\p{{N}})",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "ssn": r"(?<![\p{L}\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}-])",
    "phone": r"(?<![\p{L}\p{N}+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\p{L}\p{N}])",
    "card": r"(?<![\p{L}\p{N}])\d(?:[ -]?\d){12,18}(?![\p{L}\p{N}])",
    "person": "(?<![\\p{L}\\p{N}])(?:" + "|".join(t for v in _TITLE.values() for t in v) + r")\.? \p{Lu}[\p{L}'-]+(?: \p{Lu}[\p{L}'-]+)?",
}
#: What starts a word, and what starts with a digit, a bracket or a plus: elsewhere nothing is tried.
PATTERN = r"(?:(?<![\p{L}\p{N}])(?:%s)|(?=[\d(+])(?:%s))" % tuple("|".join(PATTERNS[k] for k in ks) for ks in (("email", "secret", "iban", "person"), ("ipv4", "ssn", "phone", "card")))

LATIN, CYRILLIC, GREEK, DIGITS, HEX = "abcdefghijklmnopqrstuvwxyz", "абвгдежзиклмнопрстуфхцчшэюя", "αβγδεζηθικλμνξοπρστυφχψω", "0123456789", "0123456789abcdef"
#: Given names by gender and script; syllables and endings of family names by script.
NAMES = {
    ("m", "latin"): ("Adam", "Albert", "Anton", "Bruno", "Carl", "Daniel", "David", "Emil", "Felix", "Hugo", "Ivan", "Jonas", "Leon", "Lucas", "Marco", "Martin", "Oscar", "Paul", "Simon", "Victor"),
    ("f", "latin"): ("Ada", "Alice", "Anna", "Bella", "Clara", "Diana", "Elena", "Emma", "Flora", "Greta", "Helen", "Ida", "Julia", "Laura", "Lena", "Maria", "Nora", "Olga", "Rosa", "Vera"),
    ("m", "cyrillic"): ("Андрей", "Борис", "Виктор", "Иван", "Максим", "Павел", "Роман", "Юрий"),
    ("f", "cyrillic"): ("Алла", "Вера", "Дарья", "Ирина", "Мария", "Нина", "Ольга", "Софья"),
}
SYLLABLES = {
    "latin": ("ba", "be", "bo", "da", "de", "di", "do", "fa", "ga", "go", "ha", "ka", "ke", "ko", "la", "le", "li", "lo", "ma", "me", "mi", "mo", "na", "ne", "no", "ra", "re", "ri", "ro", "sa", "ta", "va"),
    "cyrillic": ("ба", "бе", "бо", "ва", "ве", "во", "га", "го", "да", "де", "до", "за", "ка", "ке", "ко", "ла", "ле", "ло", "ма", "ме", "ми", "мо", "на", "не", "но", "ра", "ре", "ро", "са", "со", "та", "то"),
}
ENDINGS = {"latin": ("n", "nd", "r", "rt", "s", "l", "ck", "m"), "cyrillic": ("нко", "ных", "рук", "рян", "ских", "лян", "рич", "нюк")}


def session_key(spark: SparkSession) -> str:
    """The key of KEY_CONF; without one a random key, the same for all that this session does and unknown to others."""
    key = spark.conf.get(KEY_CONF, None)
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set(KEY_CONF, key)
    return key


def let(value: Column, f) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def entity_type(e: Column) -> Column:
    """Type of what the pattern found; null for numbers whose check sum is wrong."""
    full = lambda k: e.rlike(f"^(?:{PATTERNS[k]})$")
    digits = F.regexp_replace(e, r"\D", "")
    out = F.when(e.contains("@"), "email")
    for k in ("secret", "ipv4", "ssn", "phone"):
        out = out.when(full(k), k)
    return out.when(full("card") & (luhn(digits) % 10 == 0) & ~digits.rlike("^0+$"), "card").when(full("iban") & (mod97(e) == 1), "iban").when(full("person"), "person")


def luhn(digits: Column) -> Column:
    """Sum of the digits, every second one from the right doubled and its digits added; a multiple of 10 if the number is valid."""
    d = F.split(F.reverse(digits), "")
    one = lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2))
    return F.aggregate(F.transform(d, lambda c, i: F.when(c.rlike(r"^\d$"), one(c, i)).otherwise(0)), F.lit(0), lambda s, x: s + x)


def mod97(e: Column) -> Column:
    """Remainder of an account number by 97, letters as 10 to 35, the first four places moved to the end."""
    plain = F.regexp_replace(e, " ", "")
    moved = F.split(F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4)), "")
    value = lambda c: F.when(c.rlike("^[0-9]$"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(moved, F.lit(0), lambda s, c: (s * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97)


def value_start(e: Column, kind: Column) -> Column:
    """How many characters before the entity itself belong to its setting: the name and quote of a secret, the title of a person, the + of a phone."""
    lead = F.when(kind == "secret", F.regexp_extract(e, r"^((?i:[a-z_-]+\s{0,3}[=:]\s{0,3}[\"']?)|AKIA|gh[pousr]_|sk-)", 1)).when(kind == "person", F.regexp_extract(e, r"^(\S+ )", 1))
    return F.length(F.coalesce(lead, F.lit("")))


def canonical(e: Column, kind: Column) -> Column:
    """The entity without its setting, the separators of numbers, and case (but for secrets, whose case counts)."""
    body = F.substr(e, value_start(e, kind) + 1)
    numbers = F.regexp_replace(body, r"[^\p{L}\p{N}]", "")
    return F.when(kind.isin("phone", "card", "ssn", "iban"), F.lower(numbers)).when(kind == "secret", body).otherwise(F.lower(body))


def keystream(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """Numbers 0 to 65535, at least one for each character of the canonical form."""
    seed = F.concat_ws("\u0000", F.lit(key), kind, canon, attempt.cast("string"))
    blocks = F.transform(F.sequence(F.lit(0), (F.length(canon) / 16).cast("int")), lambda b: F.sha2(F.concat(seed, b.cast("string")), 256))
    return F.flatten(F.transform(blocks, lambda h: F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.conv(F.substr(h, i * 4 + 1, F.lit(4)), 16, 10).cast("int"))))


def _pick(letters: str, n: Column) -> Column:
    return F.substr(F.lit(letters), n % len(letters) + 1, F.lit(1))


def surrogate(key: str, kind: Column, canon: Column, attempt: Column, gender: Column) -> Column:
    """Canonical form of the surrogate: of the same length for all types but addresses and persons."""
    return let(keystream(key, kind, F.concat_ws("\u0001", canon, F.when(kind == "person", gender)), attempt), lambda ks: _drawn(ks, kind, canon, attempt, gender))


def _drawn(ks: Column, kind: Column, canon: Column, attempt: Column, gender: Column) -> Column:
    at = lambda i: F.element_at(ks, i + 1)
    chars = F.split(canon, "")
    top = F.length(F.substring_index(canon, ".", -1))  # of an e-mail address the last label stays

    def one(c: Column, i: Column) -> Column:
        n = at(i)
        hexed = (kind == "secret") & canon.rlike("^[0-9a-f]+$")
        stays = ((kind == "email") & (i >= F.length(canon) - top)) | ((kind == "iban") & (i < 2)) | ((kind == "phone") & (i < 1)) | ((kind == "card") & (i < 1))
        return (
            F.when(stays, c).when(hexed, _pick(HEX, n)).when(c.rlike(r"^\p{N}$"), _pick(DIGITS, n))
            .when(c.rlike(r"^\p{IsCyrillic}$"), _pick(CYRILLIC, n)).when(c.rlike(r"^\p{IsGreek}$"), _pick(GREEK, n))
            .when(c.rlike(r"^\p{Lu}$"), F.upper(_pick(LATIN, n))).when(c.rlike(r"^\p{L}$"), _pick(LATIN, n)).otherwise(c)
        )

    def numbered(same: Column) -> Column:
        short = F.substr(same, F.lit(1), F.length(same) - 1)
        card = F.concat(short, F.pmod(-luhn(F.concat(short, F.lit("0"))), F.lit(10)).cast("string"))
        checked = F.concat(F.substring(same, 1, 2), F.lit("00"), F.substring(same, 5, 64))
        iban = F.concat(F.substring(same, 1, 2), F.lpad((98 - mod97(F.upper(checked))).cast("string"), 2, "0"), F.substring(same, 5, 64))
        return F.when(kind == "card", card).when(kind == "iban", iban).otherwise(same)

    # from the end of the numbers, of which there are 16 at least; more than 8 further characters are never needed
    more = F.slice(ks, -8, F.least(F.greatest(attempt.cast("int") - WIDE_AFTER, F.lit(0)), F.lit(8)))
    letters = F.array_join(F.transform(more, lambda n: _pick(LATIN, n)), "")
    digits = F.array_join(F.transform(more, lambda n: _pick(DIGITS, n)), "")

    def widened(same: Column) -> Column:
        return F.when(kind == "email", F.concat(F.substring_index(same, "@", 1), letters, F.lit("@"), F.substring_index(same, "@", -1))).when(kind == "secret", F.concat(same, letters)).otherwise(F.concat(same, digits))

    ip = F.array_join(F.transform(F.slice(ks, 1, 4), lambda n: (n % 254 + 1).cast("string")), ".")
    port = F.when(F.size(more) > 0, F.concat(F.lit(":"), F.array_join(F.transform(more, lambda n: n.cast("string")), ""))).otherwise("")
    laid = let(F.array_join(F.transform(chars, one), ""), lambda same: numbered(widened(same)))
    return F.when(kind == "ipv4", F.concat(ip, port)).when(kind == "person", F.lower(person(ks, canon, gender, attempt))).otherwise(laid)


def person(ks: Column, canon: Column, gender: Column, attempt: Column) -> Column:
    """A family name, and a given name before it if there were two, of the gender and script; the family name has three syllables and one more for each further attempt."""
    pick = lambda seq, n: F.element_at(F.array(*map(F.lit, seq)), n % len(seq) + 1)
    drawn = F.slice(ks, F.lit(3), F.least(attempt.cast("int") + 3, F.lit(14)))  # there are 16 numbers at least

    def named(script: str) -> Column:
        given = F.when(gender == "f", pick(NAMES["f", script], F.element_at(ks, 1))).otherwise(pick(NAMES["m", script], F.element_at(ks, 1)))
        family = F.concat(F.array_join(F.transform(drawn, lambda n: pick(SYLLABLES[script], n)), ""), pick(ENDINGS[script], F.element_at(ks, 2)))
        return F.when(canon.contains(" "), F.concat_ws(" ", given, family)).otherwise(family)

    return F.when(canon.rlike(r"\p{IsCyrillic}"), named("cyrillic")).otherwise(named("latin"))


def gender_of(e: Column) -> Column:
    """Gender that a title tells."""
    return F.when(e.rlike("^(?:" + "|".join(_TITLE["f"]) + r")\b"), "f").otherwise("m")


def spelled(e: Column, kind: Column, sub: Column) -> Column:
    """The surrogate in the spelling of the entity: its setting, its separators, its capitals."""
    start = value_start(e, kind)
    lead, body = F.substr(e, F.lit(1), start), F.substr(e, start + 1)
    state = lambda o, n: F.struct(o.alias("o"), n.alias("n"))
    separates = kind.isin("phone", "card", "ssn", "iban")

    def step(s: Column, c: Column) -> Column:
        new = F.substr(sub, s["n"] + 1, F.lit(1))
        new = F.when(c.rlike(r"^\p{Lu}$"), F.upper(new)).otherwise(new)
        skip = separates & c.rlike(r"^[^\p{L}\p{N}]$")
        return F.when(skip, state(F.concat(s["o"], c), s["n"])).otherwise(state(F.concat(s["o"], new), s["n"] + 1))

    laid = F.aggregate(F.split(body, ""), state(F.lit(""), F.lit(0)), step, lambda s: F.concat(s["o"], F.substr(sub, s["n"] + 1)))
    return F.concat(lead, F.when(kind == "ipv4", sub).when(kind == "person", F.initcap(sub)).when(kind == "secret", sub).otherwise(laid))


def typed(e: Column) -> Column:
    """Type (null: nothing private after all), canonical form and a person's gender of what the pattern found."""
    kind = lambda k: F.struct(k.alias("kind"), canonical(e, k).alias("canon"), F.when(k == "person", gender_of(e)).otherwise("").alias("gender"))
    return let(entity_type(e), kind)


def attempts(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canon, entity_gender, attempt) of the entities whose surrogate is not that of attempt 0, after the collision checks. entities: distinct (kind, canon, gender)."""
    own = ["kind", "canon", "gender"]
    tasks = int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sub = lambda attempt: surrogate(key, F.col("kind"), F.col("canon"), attempt, F.col("gender"))
    # few bytes but much work: dealt out by number, which Spark doesn't coalesce
    table = materialize(entities.select(*own).repartition(tasks, *own).select(*own, F.lit(0).alias("attempt"), sub(F.lit(0)).alias("sub")), "entities")
    while True:
        forms = table.select(*own, F.col("sub").alias("form"), F.lit(False).alias("real")).unionAll(table.select(*own, F.col("canon").alias("form"), F.lit(True).alias("real")))
        same = Window.partitionBy("kind", "form")  # one form: a few entities that collide
        seen = forms.withColumn("taken", F.max("real").over(same)).withColumn("keeps", F.min(F.when(~F.col("real"), F.struct("canon", "gender"))).over(same))
        clash = materialize(seen.where(~F.col("real") & (F.col("taken") | (F.struct("canon", "gender") != F.col("keeps")))).select(*own), "clashes")
        if clash.isEmpty():
            return table.where("attempt > 0").select("kind", "canon", F.col("gender").alias("entity_gender"), "attempt")
        again = table.join(clash.withColumn("again", F.lit(True)), own, "left").repartition(tasks, *own)
        again = again.withColumn("attempt", F.col("attempt") + F.when(F.col("again"), 1).otherwise(0))
        table = materialize(again.select(*own, "attempt", F.when(F.col("again"), sub(F.col("attempt"))).otherwise(F.col("sub")).alias("sub")), "entities")


def replace(df: DataFrame, key: str | None = None, text: str = "text") -> DataFrame:
    """df with its text rewritten, and `entities`: type and surrogate of each, in order. The originals are not returned. key: that of the session if none is given."""
    key = key or session_key(df.sparkSession)
    if clash := {"entities", "__raw", "__row", "__late"} & set(df.columns):
        raise ValueError(f"columns in the way: {sorted(clash)}")
    # the texts are searched once; row numbers are drawn once and written, so every later reader sees the same
    base = materialize(df.withColumn("__raw", F.regexp_extract_all(F.col(text), F.lit(PATTERN), F.lit(0))).withColumn("__row", F.monotonically_increasing_id()), "found")
    each = base.where(F.size("__raw") > 0).select("__row", F.explode("__raw").alias("e"))
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spellings = each.select("e").distinct().repartition(tasks, "e").select("e", typed(F.col("e")).alias("x")).select("e", "x.*").where("kind is not null")
    spellings = materialize(spellings, "spellings")
    late = attempts(spellings.select("kind", "canon", "gender").distinct(), key)
    if late.isEmpty():
        base = base.withColumn("__late", F.lit(None).cast("map<string,int>"))
    else:  # few rows have such an entity; they meet it by a join
        tries = each.join(spellings.join(late.withColumnRenamed("entity_gender", "gender"), ["kind", "canon", "gender"]).select("e", "attempt"), "e").select("__row", "e", "attempt").distinct()
        base = base.join(tries.groupBy("__row").agg(F.map_from_entries(F.collect_list(F.struct("e", "attempt"))).alias("__late")), "__row", "left")
    with_type = F.transform("__raw", lambda e: F.struct(e.alias("e"), F.coalesce(F.try_element_at(F.col("__late"), e), F.lit(0)).alias("attempt"), typed(e).alias("x")))

    def replaced(y: Column) -> Column:
        x = y["x"]
        new = F.when(x["kind"].isNull(), y["e"]).otherwise(let(surrogate(key, x["kind"], x["canon"], y["attempt"], x["gender"]), lambda sub: spelled(y["e"], x["kind"], sub)))
        return F.struct(x["kind"].alias("kind"), new.alias("surrogate"))

    none = F.array().cast("array<struct<kind:string,surrogate:string>>")
    out = base.withColumn("entities", F.when(F.size("__raw") > 0, F.transform(with_type, replaced)).when(F.col(text).isNotNull(), none))
    gaps = F.split(F.col(text), PATTERN, -1)
    woven = let(gaps, lambda g: F.concat(F.element_at(g, 1), F.array_join(F.zip_with(F.transform("entities", lambda x: x["surrogate"]), F.slice(g, F.lit(2), F.greatest(F.size(g) - 1, F.lit(0))), lambda a, b: F.concat(a, b)), "")))
    out = out.withColumn(text, F.when(F.size("entities") > 0, woven).otherwise(F.col(text)))
    return out.select(*df.columns, F.filter("entities", lambda x: x["kind"].isNotNull()).alias("entities"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with surrogates in place of what is private."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return replace(docs).select("doc_id", "text", F.coalesce(F.size("entities"), F.lit(0)).alias("n_entities"), "entities")


QUERIES = {"op8_pii": op8_pii}
