"""Surrogates for personal data, in DataFrame operations only.

E-mail addresses, phone, card, social security and bank account numbers, IPv4 addresses and
names behind titles are found by one pattern over the whole text. Every distinct value gets a
surrogate of its own kind, drawn by a keyed hash: digits for digits, letters of the same script
and case for letters, given names by the gender of the title, addresses in networks and domains
that nobody owns, valid check digits where the original has them. The same value has the same
surrogate everywhere; later bare mentions of a name in a document follow the name. Surrogates
that meet another or an original value are drawn again until all differ.

Names draw by their value alone, so one name has one surrogate in all documents; its ending goes by the titles it
stands behind anywhere (men's, women's, both or neither). An initial stays. After collisions names are drawn longer, so
there are always enough; other formats keep their length and raise an error if they run out.

Texts without personal data are returned as they are and take part in no shuffle. Nulls: a null
text stays null. Empty texts hold nothing; very long ones are treated whole, in one row. Repeated rows are treated alike; ties of
draws go to the least value. Other columns are kept, whatever their names: the input travels as one struct,
and the count's name is the caller's. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logsift.session import shared_dir

# Titles by gender; fixed values of the languages.
MALE = ["Mr", "Herr", "Herrn", "Señor", "Sr", "Monsieur", "г-н"]
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Señora", "Señorita", "Sra", "Srta", "Madame", "Mme", "Mademoiselle", "Mlle", "г-жа"]
NEUTRAL = ["Dr", "Prof"]
NAME = r"\p{Lu}(?:['’]\p{Lu})?\p{L}*\p{L}(?:['’]\p{L}{2,})?"  # also with inner capitals or an apostrophe
UPPER = [t.upper() for t in ("Mr", "Mrs", "Dr", "Prof")]  # with a full stop: MS or SR without one is none
TITLED = rf"(?<!\p{{L}})(?:(?:{'|'.join(MALE + FEMALE + NEUTRAL)})\.?|(?:{'|'.join(UPPER)})\.) (?:\p{{Lu}}\. ?){{0,2}}{NAME}(?:[ \-]{NAME}){{0,2}}(?!\p{{L}})"
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
EMAIL = r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]{1,64}@(?:[\p{L}\p{N}\-]{1,63}\.){1,8}\p{L}{2,24}(?![\p{L}\p{N}])"
IP = rf"(?<![\w.]){OCTET}(?:\.{OCTET}){{3}}(?!\w|\.\d)"
PHONE = r"(?<![\w+])\+\d{1,3}[ .\-]?\(?\d{2,4}\)?(?:[ .\-]?\d{2,4}){1,4}(?!\w)|(?<![\w)])\(\d{3}\) ?\d{3}[ .\-]\d{4}(?!\w)|(?<![\w.\-])\d{3}[.\-]\d{3}[.\-]\d{4}(?![\w\-])"
CARD = r"(?<![\w\-])(?:(?:4\d{3}|5[1-5]\d\d|2[2-7]\d\d|6(?:011|5\d\d))(?:[ \-]?\d{4}){3}|3[47]\d\d[ \-]?\d{6}[ \-]?\d{5})(?![\w\-])"
SSN = r"(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-])"
IBAN = r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"
PATTERN = "|".join((EMAIL, CARD, SSN, IP, PHONE, IBAN, TITLED))
#: What every text with a match holds; a cheap first look.
SOME = rf"[0-9@]|{TITLED}"
CLASSES = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "абвгдежзиклмнопрстуфхцчшэюя", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"]
SYLLABLES = "ba be bi bo da de di do fa fe fi ga ge go ha he ja jo ka ke ki ko la le li lo ma me mi mo na ne ni no pa pe ra re ri ro sa se si so ta te ti to va ve vi vo wa we wi ya yo za ze zi zo".split()
ENDINGS = {"given_m": ["n", "r", "s", "k"], "given_f": ["na", "lia", "ra", "ssa"], "given_n": ["x", "nn", "ry", "li"], "family": ["ner", "son", "wald", "mont"]}


# Where the parts of a titled name meet.
BETWEEN = r"[ \-]|(?<=\.)(?=\p{L})"


def _hash(*parts: Column) -> Column:
    """A non-negative integer from a keyed hash."""
    return F.conv(F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 13), 16, 10).cast("long")


def _pick(values: list[str], h: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (h % len(values) + 1).cast("int"))


def _scrambled(text: Column, seed: Column) -> Column:
    """Every digit and letter drawn anew from its own class; all else stays."""

    def one(c: Column, i: Column) -> Column:
        h, out = _hash(seed, i.cast("string")), c
        for letters in CLASSES:
            out = F.when(F.instr(F.lit(letters), c) > 0, F.substring(F.lit(letters), (h % len(letters) + 1).cast("int"), F.lit(1))).otherwise(out)
        return F.when(c == "", c).otherwise(out)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum of a digit string, the last digit counted singly."""
    def value(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == 1, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), value), F.lit(0), lambda s, x: s + x)


def surrogate(kind: Column, value: Column, seed: Column, role: Column, draw: Column) -> Column:
    """The surrogate of a value under a seed of key, kind, value and draw; `role` is the ending of a name."""
    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    labels = F.split(domain, r"\.")
    inner = F.when(F.size(labels) > 2, F.concat(_scrambled(F.array_join(F.slice(labels, 1, F.size(labels) - 2), "."), F.concat(seed, F.lit("d"))), F.lit(".example."))).otherwise("example.")
    email = F.concat(_scrambled(local, seed), F.lit("@"), inner, _pick(["com", "net", "org"], _hash(seed, F.lit("t"))))
    h = _hash(seed)
    octet = lambda k: (F.shiftright(h, 8 * k) % 254 + 1).cast("string")
    ip = F.concat_ws(".", (h % 15 + 240).cast("string"), octet(1), octet(2), octet(3))  # a reserved network
    keep = F.when(value.startswith("+"), F.regexp_extract(value, r"^\+\d{1,3}(?=[^\d])|^\+\d", 0)).otherwise("")
    phone = F.concat(keep, _scrambled(F.substring(value, F.length(keep) + 1, F.length(value)), seed))
    drawn = F.concat(F.substring(value, 1, 2), _scrambled(F.substring(value, 3, F.length(value)), seed))
    digits = F.regexp_replace(drawn, r"\D", "")
    check = (10 - _luhn_sum(F.concat(F.substring(digits, F.lit(1), F.length(digits) - 1), F.lit("0"))) % 10) % 10
    valid = _luhn_sum(F.regexp_replace(value, r"\D", "")) % 10 == 0
    card = F.when(valid, F.concat(F.substring(drawn, F.lit(1), F.length(drawn) - 1), check.cast("string"))).otherwise(drawn)
    iban = F.concat(F.substring(value, 1, 2), _scrambled(F.substring(value, 3, F.length(value)), seed))
    syllables = F.array_join(F.transform(F.sequence(F.lit(1), 3 + F.floor(draw / 3).cast("int")), lambda k: _pick(SYLLABLES, _hash(seed, F.concat(F.lit("s"), k.cast("string"))))), "")
    latin = F.lit(None).cast("string")
    for k, ends in ENDINGS.items():
        latin = F.when(role == k, F.concat(syllables, _pick(ends, _hash(seed, F.lit("e"))))).otherwise(latin)
    longer = F.concat(value, F.repeat(F.substring(value, -1, 1), F.floor(draw / 3).cast("int")))
    name = F.when(value.rlike(r"^\p{IsLatin}+$"), F.when((value == F.upper(value)) & (F.length(value) > 1), F.upper(latin)).otherwise(F.initcap(latin))).otherwise(_scrambled(longer, seed))
    out = name
    for k, v in (("email", email), ("ip", ip), ("phone", phone), ("card", card), ("ssn", _scrambled(value, seed)), ("iban", iban)):
        out = F.when(kind == k, v).otherwise(out)
    return out


def _kind(value: Column) -> Column:
    return (
        F.when(value.contains("@"), "email")
        .when(value.rlike(rf"^(?:{CARD})$"), "card")
        .when(value.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(value.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"), "ip")
        .when(value.rlike(r"^[+(\d]"), "phone")
        .when(value.rlike(r"^[A-Z]{2}\d"), "iban")
        .otherwise("name")
    )


def _has(text: Column) -> Column:
    return F.coalesce(text.rlike(SOME) & text.rlike(PATTERN), F.lit(False))


def _titled(value: Column) -> Column:
    """The title of a titled name."""
    return F.regexp_extract(value, r"^(\S+?)\.? ", 1)


def _names(matches: Column) -> Column:
    """(kind, value, role) of the names in titled matches: one name is a family's, of more the first is given."""
    def of(m: Column) -> Column:
        parts = F.filter(F.split(F.regexp_replace(m, r"^\S+ ", ""), BETWEEN), lambda p: p.rlike(r"\p{L}['’]?\p{L}") & ~p.contains("."))
        title = F.lower(_titled(m))
        is_one = lambda titles: title.isin([t.lower() for t in titles])
        given = F.when(is_one(MALE), "given_m").when(is_one(FEMALE), "given_f").otherwise("given_n")
        return F.transform(parts, lambda p, i: F.struct(F.lit("name").alias("kind"), p.alias("value"), F.when((i == 0) & (F.size(parts) > 1), given).otherwise("family").alias("role")))

    return F.flatten(F.transform(F.filter(matches, lambda m: _kind(m) == "name"), of))


def _found(docs: DataFrame) -> DataFrame:
    """Of docs(text, ...) those with personal data: `found` is all matches in order, `pattern` finds them again
    and bare mentions of names too, `names` holds the names."""
    out = docs.where(_has(F.col("text"))).withColumn("names", _names(F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))))
    bare = F.array_join(F.array_distinct(F.transform("names", lambda n: n["value"])), "|")
    pattern = F.when(F.size("names") > 0, F.concat(F.lit(PATTERN + r"|(?<!\p{L})(?:"), bare, F.lit(r")(?!\p{L})"))).otherwise(PATTERN)
    return out.withColumn("pattern", pattern).withColumn("found", F.regexp_extract_all(F.col("text"), F.col("pattern"), F.lit(0)))


def _entities() -> Column:
    """Distinct (kind, value, role) to be replaced in a found document."""
    plain = F.transform(F.filter("found", lambda m: _kind(m) != "name"), lambda m: F.struct(_kind(m).alias("kind"), m.alias("value"), F.lit("").alias("role")))
    return F.array_distinct(F.concat(plain, "names"))


def surrogate_table(entities: DataFrame, key: str) -> DataFrame:
    """(kind, value, surrogate) of entities(kind, value, role); the surrogates differ from each other and from all originals of the kind."""
    spark = entities.sparkSession
    entities = entities if "role" in entities.columns else entities.withColumn("role", F.lit(""))
    is_role = lambda *roles: F.max(F.col("role").isin(*roles))
    role = F.when(is_role("given_m") & is_role("given_f") | is_role("given_n") & ~is_role("given_m", "given_f"), "given_n").when(is_role("given_m"), "given_m").when(is_role("given_f"), "given_f").otherwise("family")
    path = shared_dir(spark, "values")
    entities.groupBy("kind", "value").agg(role.alias("role")).write.parquet(path)
    values = spark.read.parquet(path)
    table = values.withColumn("draw", F.lit(0))
    while True:
        seed = F.concat_ws("\x1f", F.lit(key), "kind", "value", F.col("draw").cast("string"))
        path = shared_dir(spark, "surrogates")
        table.select("kind", "value", "role", "draw", surrogate(F.col("kind"), F.col("value"), seed, F.col("role"), F.col("draw")).alias("surrogate")).write.parquet(path)
        drawn = spark.read.parquet(path)
        first = F.row_number().over(Window.partitionBy("kind", "surrogate").orderBy("draw", "value")) > 1
        original = values.select("kind", F.col("value").alias("surrogate"), F.lit(True).alias("taken"))
        judged = drawn.withColumn("twice", first).join(original, ["kind", "surrogate"], "left").withColumn("again", F.col("twice") | F.col("taken").isNotNull())
        left = judged.where("again").count()
        if not left:
            return drawn.select("kind", "value", "surrogate")
        if drawn.where("kind <> 'name'").agg(F.coalesce(F.max("draw"), F.lit(0))).first()[0] > 60:
            raise ValueError(f"{left} values have no surrogate of their own: a format has too few")
        table = judged.select("kind", "value", "role", (F.col("draw") + F.col("again").cast("int")).alias("draw"))


def replace_personal(docs: DataFrame, key: str, text: str = "text", count: str | None = "n_entities") -> DataFrame:
    """docs with surrogates in `text`, and in a last column `count` how many places were replaced (None: no such column)."""
    if count is not None and count in docs.columns:
        raise ValueError(f"the input has a column {count}; give the count another name")
    spark, quoted = docs.sparkSession, [f"`{c.replace('`', '``')}`" for c in docs.columns]
    rows = docs.select(F.struct(*quoted).alias("row"), F.col(f"`{text}`").alias("text"))
    found = _found(rows).withColumn("text_id", F.sha2("text", 256))
    path = shared_dir(spark, "entities")
    found.select("text_id", F.explode(_entities()).alias("e")).select("text_id", "e.*").distinct().write.parquet(path)
    in_texts = spark.read.parquet(path)
    table = surrogate_table(in_texts, key)
    maps = in_texts.select("text_id", "kind", "value").distinct().join(table, ["kind", "value"]).groupBy("text_id").agg(F.collect_list(F.struct("value", "surrogate")).alias("pairs"))
    maps = maps.select("text_id", F.map_from_entries(F.expr("array_sort(filter(pairs, (x, i) -> i = 0 or not exists(slice(pairs, 1, i), y -> y.value = x.value)))")).alias("map"))

    def new(m: Column) -> Column:
        parts = F.regexp_replace(m, r"^\S+ ", "")
        gaps = F.regexp_extract_all(parts, F.lit(BETWEEN), F.lit(0))
        names = F.transform(F.split(parts, BETWEEN), lambda p, i: F.concat(F.coalesce(F.element_at("map", p), p), F.coalesce(F.get(gaps, i), F.lit(""))))
        titled = F.concat(F.regexp_extract(m, r"^\S+ ", 0), F.array_join(names, ""))
        return F.coalesce(F.element_at("map", m), titled)

    replaced = F.array_join(F.zip_with(F.split(F.col("text"), F.col("pattern"), -1), F.transform("found", new), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    done = found.join(maps, "text_id", "left").select("row", replaced.alias("text"), F.size("found").cast("long").alias("n"))
    both = rows.where(~_has(F.col("text"))).withColumn("n", F.lit(0).cast("long")).unionByName(done)
    return both.select(*(F.col("text").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns), *([F.col("n").alias(count)] if count else []))


def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return replace_personal(docs.select("doc_id", "lang", "source", "text"), key="surrogates-1")
