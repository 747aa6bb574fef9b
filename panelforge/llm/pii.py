"""Personal data replaced by surrogates, with DataFrame functions alone.

Found entities (mail and network addresses, telephone, card, bank and identity numbers, dates of birth behind words that say so,
names behind a title) become keyed surrogates of the same type and shape: digits become digits and letters letters of the same
case, in the places where the original has them; card numbers keep their network digit and a right check digit stays right;
names come from lists by gender and script (Latin, Cyrillic, Greek, Armenian; names in scripts without capitals are not found).
Names without a title are not found. All spellings of an entity share one canonical form and so one surrogate, across all
documents: a telephone number with and without its country's code, a date in any order. First and last names are entities of their own, so
`Mrs Anna Smith`, `Mrs Smith` and `Dr Smith` keep sharing a last name; a first name's gender is what its titles in the corpus agree on.
Digests are keyed (HMAC-SHA256).

Surrogates are checked over the whole corpus: if two entities get the same one, or a surrogate is itself an entity of the
corpus, the later entity draws again. From the fourth time on it draws from a wider range (longer mails, more digits, more years), and
what clashes even then is numbered: a number is used once, so each round uses up what is in its way, and rounds come to an end.

No pattern repeats a group without bound (such a group takes stack for each repetition), so texts of any length are safe. A mail's domain
has at most 126 labels, as many as a domain can have, and a name's parts at most 40 letters.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.common import discard, docs_text, free_name, joined, numbered, spread, stage
from panelforge.llm.spans import between, matched

MAIL = r"[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,126}[A-Za-z]{2,24}"
WORLD = r"(?<![\w+])(?=\+(?:[ ./()-]{0,2}\d){8,15}(?!\d))\+\d{1,3}(?:[ ./-]?\(?\d{2,8}\)?){2,5}(?![\w-])"
NATIONAL = r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{3}[ .-])\d{3,4}[ .-]\d{4}(?![\w-])"
TRUNK = r"(?<![\w+./-])0\d{2,4}[ /-]\d{3,4}[ -]?\d{3,5}(?![\w./-]\w)"
PHONE = f"(?:{WORLD})|(?:{NATIONAL})|(?:{TRUNK})"
ADDRESS6 = r"(?<![\w:.])(?=[A-Fa-f:]*\d)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:])"
DATE = r"(?:\d{4}-\d{2}-\d{2}|\d{1,2}[./]\d{1,2}[./]\d{4})"
BORN = rf"(?<![\p{{L}}\p{{N}}])(?i:born(?: on)?|date of birth|DOB|geboren am|née? le|nacid[oa] el|родил(?:ся|ась))[: ]{{1,3}}{DATE}(?!\d)"
ADDRESS = r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)"
IDENTITY = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
BANK = r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"
CARD = r"(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-])"
MALE = r"Mr|Herr|Monsieur|Señor|Sr|г-н|Κύριος|κ"
FEMALE = r"Mrs|Ms|Miss|Frau|Madame|Mme|Mlle|Señora|Señorita|Sra|Srta|г-жа|Κυρία|κα"
NAME = rf"(?<![\p{{L}}\p{{N}}])(?:{MALE}|{FEMALE}|Dr|Prof)\.? \p{{Lu}}\p{{Ll}}{{1,40}}(?:[ -]\p{{Lu}}\p{{Ll}}{{1,40}})?(?!\p{{Ll}})"
#: In the order in which a place in a text is tried.
TYPES = {"mail": MAIL, "address": ADDRESS, "address6": ADDRESS6, "born": BORN, "identity": IDENTITY, "phone": PHONE, "bank": BANK, "card": CARD, "name": NAME}
ANY = "|".join(f"(?:{p})" for p in TYPES.values())
#: Without one of these a text holds no entity.
HINT = rf"[0-9@]|(?<![\p{{L}}\p{{N}}])(?:{MALE}|{FEMALE}|Dr|Prof)\.? \p{{Lu}}"
#: Surrogate names by script, gender and place; (any) stands for titles that do not tell.
FIRST = {
    "latin": {"m": "Adam Bruno Carl David Erik Felix Georg Henry Ivan Jonas Karl Leon Marco Nils Oscar Paul Robin Simon Tom Victor", "f": "Anna Berta Clara Diana Elena Flora Greta Helen Irene Julia Karla Laura Maria Nina Olga Petra Rosa Sofia Tina Vera"},
    "cyrillic": {"m": "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим", "f": "Анна Вера Галина Дарья Елена Жанна Ирина Кира Лидия Мария"},
    "greek": {"m": "Ανδρέας Γιώργος Δημήτρης Ηλίας Κώστας Νίκος Πέτρος Σπύρος", "f": "Άννα Ελένη Ιωάννα Κατερίνα Μαρία Σοφία Χριστίνα"},
    "armenian": {"m": "Արամ Արմեն Գագիկ Դավիթ Հայկ Տիգրան", "f": "Անահիտ Գոհար Լիլիթ Մարիամ Նարե Սոնա"},
}
LAST = {
    "latin": "Abbot Berger Castell Dumont Ericson Falk Garner Holm Ibarra Jansen Keller Lindt Moreau Novak Olsen Perrin Quint Roth Salas Thorne Ullman Vidal Weber Yates Zeller",
    "cyrillic": "Волков Громов Дронов Ершов Жилин Зимин Котов Лавров Мохов Носов",
    "greek": "Βασιλείου Γεωργίου Δήμου Ιωάννου Κωνσταντίνου Μάρκου Νικολάου Πέτρου",
    "armenian": "Աբրահամյան Գրիգորյան Հակոբյան Մկրտչյան Պետրոսյան Սարգսյան",
}
#: Letters of each script for names that need a second part, in place of a to z.
LETTERS = {"cyrillic": "абвгдежзиклмнопрстуфхцчшэю", "greek": "αβγδεζηθικλμνξοπρστυφχψωάέ", "armenian": "աբգդեզէըթժիլխծկհձղճմյնշոչպ"}
SCRIPTS = {"cyrillic": r"\p{IsCyrillic}", "greek": r"\p{IsGreek}", "armenian": r"\p{IsArmenian}"}


def keyed(key: str, message: Column) -> Column:
    """HMAC-SHA256 in hexadecimal digits."""
    raw = key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in raw)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def key_of(spark: SparkSession) -> str:
    """The key that ``spark.panelforge.surrogateKey`` names; where none is set, one that is no secret, for tests."""
    return spark.conf.get("spark.panelforge.surrogateKey", None) or "no secret"


def kind_of(found: Column) -> Column:
    return F.coalesce(*[F.when(found.rlike(f"^(?:{p})$"), F.lit(k)) for k, p in TYPES.items() if k != "name"], F.lit("name"))


def canonical(kind: Column, found: Column) -> Column:
    """One form for all spellings: small letters for mail, digits for numbers, a name as it is."""
    return F.when(kind.isin("mail", "address6"), F.lower(found)).when(kind == "address", found).when(kind.isin("first", "last"), found).when(kind == "phone", national(found)).when(kind == "born", born(found)).when(kind == "bank", F.regexp_replace(found, " ", "")).otherwise(F.regexp_replace(found, "[^0-9]", ""))


def national(found: Column) -> Column:
    """A telephone number's digits without the country's code and leading zeros; ten digits of one without separators."""
    digits = F.regexp_replace(F.regexp_replace(found, r"^\+\d{1,3}(?=[ ./(-])", ""), "[^0-9]", "")
    digits = F.when(found.rlike(r"^\+\d{4}"), F.right(digits, F.lit(10))).otherwise(digits)
    return F.regexp_replace(digits, "^0+(?=.)", "")


def born(found: Column) -> Column:
    """yyyy-MM-dd, or the digits of what is no date."""
    d = F.regexp_extract(found, f"{DATE}$", 0)
    made = F.coalesce(F.try_to_date(F.when(d.contains("-"), d), "yyyy-MM-dd"), F.try_to_date(F.when(~d.contains("-"), F.replace(d, F.lit("/"), F.lit("."))), "d.M.yyyy"))
    return F.coalesce(F.date_format(made, "yyyy-MM-dd"), F.regexp_replace(d, "[^0-9]", ""))


def letter(digest: Column, at: Column, letters: str) -> Column:
    """A keyed letter for a place: two hexadecimal digits of the digest, taken round and round."""
    value = F.conv(F.substr(digest, at % 62 + 1, F.lit(2)), 16, 10).cast("int")
    return F.substr(F.lit(letters), value % len(letters) + 1, F.lit(1))


def like(text: Column, digest: Column, from_place: int | Column = 0) -> Column:
    """``text`` with keyed digits and letters in place of its own from a place on; case and all other characters stay."""
    places = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)))

    def one(i: Column) -> Column:
        c, at = F.substr(text, i, F.lit(1)), i * 3
        made = F.when(c.rlike("[0-9]"), letter(digest, at, "0123456789")).when(c.rlike("[a-z]"), letter(digest, at, "abcdefghijklmnopqrstuvwxyz")).when(c.rlike("[A-Z]"), letter(digest, at, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).otherwise(c)
        return F.when(i <= from_place, c).otherwise(made)

    return F.array_join(F.transform(places, one), "")


def luhn(number: Column) -> Column:
    """The check sum of a card number; 0 if it is right."""
    n = F.length(number)
    digits = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.substr(number, i, F.lit(1)).cast("int").alias("d"), ((n - i) % 2 == 1).alias("twice")))
    worth = lambda x: F.when(x["twice"], F.when(x["d"] > 4, x["d"] * 2 - 9).otherwise(x["d"] * 2)).otherwise(x["d"])
    return F.aggregate(digits, F.lit(0), lambda acc, x: acc + worth(x)) % 10


def pick(words: str, digest: Column, at: int) -> Column:
    own = words.split()
    return F.element_at(F.array(*map(F.lit, own)), F.conv(F.substring(digest, at, 6), 16, 10).cast("int") % len(own) + 1)


def parts(found: Column) -> Column:
    """What of a found place is one entity: array<struct<part, before, kind, found, sex, ends>>, a name's parts or the whole."""
    title, kind = F.regexp_extract(found, r"^\S+ ", 0), kind_of(found)
    names = F.split(F.substr(found, F.length(title) + 1, F.length(found)), " ")
    sex = F.when(found.rlike(rf"^(?:{FEMALE})\b"), "f").when(found.rlike(rf"^(?:{MALE})\b"), "m")

    def part(k: int, before: Column, kind: Column, own: Column, ends: bool) -> Column:
        return F.struct(F.lit(k).alias("part"), before.alias("before"), kind.alias("kind"), own.alias("found"), F.when(kind == "first", sex).alias("sex"), F.lit(ends).alias("ends"))

    first, last = F.lit("first"), F.lit("last")
    both = F.array(part(0, title, first, F.get(names, 0), False), part(1, F.lit(" "), last, F.get(names, 1), True))
    one = F.array(part(0, title, last, F.get(names, 0), True))
    return F.when(kind != "name", F.array(part(0, F.lit(""), kind, found, True))).when(F.size(names) > 1, both).otherwise(one)


def script_of(form: Column, each) -> Column:
    """``each`` of the script that a name is in."""
    out = each("latin")
    for name, sign in SCRIPTS.items():
        out = F.when(form.rlike(sign), each(name)).otherwise(out)
    return out


def spelled(form: Column, word: Column) -> Column:
    """``word`` in letters of the script that ``form`` is in."""
    return script_of(form, lambda s: F.translate(word, "abcdefghijklmnopqrstuvwxyz", LETTERS[s]) if s in LETTERS else word)


def numbered_surrogate(kind: Column, form: Column, number: Column) -> Column:
    """A surrogate that has ``number`` in it, so that different numbers give different ones; there is no last number."""
    digits = F.lpad(number.cast("string"), 18, "0")
    groups = F.regexp_replace(F.lpad(F.lower(F.hex(number)), 16, "0"), "(.{4})(?=.)", "$1:")
    date = F.concat_ws("-", (number.cast("long") / 336).cast("long") + 10_000, F.lpad(((number % 336) / 28).cast("int") + 1, 2, "0"), F.lpad(number % 28 + 1, 2, "0"))
    name = F.initcap(spelled(form, F.translate(number.cast("string"), "0123456789", "abcdefghij")))
    made = F.when(kind == "mail", F.concat(F.lit("u"), number.cast("string"), F.lit("@mail.example"))).when(kind == "address", F.concat(F.lit("fd00:0:0:0:"), groups)).when(kind == "address6", F.concat(F.lit("fd01:0:0:0:"), groups))
    return made.when(kind == "born", date).when(kind.isin("first", "last"), name).otherwise(F.concat(F.lit("1"), digits))


def surrogate(kind: Column, form: Column, sex: Column, key: str, attempt: Column) -> Column:
    """The surrogate's canonical form."""
    digest = keyed(key, F.concat_ws("|", kind, form, attempt.cast("string")))
    # short mails have few surrogates of their shape: draws from the fourth on append letters, more of them from time to time
    wider = F.when(attempt > 3, like(F.repeat(F.lit("a"), F.least(F.lit(24), 4 + (attempt / 8).cast("int"))), F.sha2(digest.cast("binary"), 256))).otherwise("")
    mail = F.concat(like(F.substring_index(form, "@", 1), digest), wider, F.lit("@"), like(F.regexp_extract(form, r"@(.+)\.[a-z]+$", 1), F.reverse(digest)), F.lit(".example"))
    octet = lambda k: (F.conv(F.substring(digest, 1 + 4 * k, 4), 16, 10).cast("int") % 254 + 1).cast("string")
    address = F.concat_ws(".", *(octet(k) for k in range(4)))
    card = like(form, digest, 1)
    stem = F.substr(card, F.lit(1), F.length(card) - 1)
    checked = F.concat(stem, F.substr(F.lit("0987654321"), luhn(F.concat(stem, F.lit("0"))) + 1, F.lit(1)))
    card = F.when(luhn(form) == 0, checked).otherwise(card)
    male = (sex == "m") | ((sex == "any") & (F.substring(digest, 60, 1) < "8"))
    first = F.when(male, script_of(form, lambda s: pick(FIRST[s]["m"], digest, 1))).otherwise(script_of(form, lambda s: pick(FIRST[s]["f"], digest, 1)))
    last = script_of(form, lambda s: pick(LAST[s], digest, 9))
    # names are few in the lists: a later draw adds a second part, so there are enough for any corpus
    more = F.when(attempt > 0, F.concat(F.lit("-"), F.initcap(spelled(form, like(F.lit("abcdefgh"), F.reverse(digest)))))).otherwise("")
    name = F.concat(F.when(kind == "first", first).otherwise(last), more)
    longer = F.when(attempt > 3, like(F.repeat(F.lit("0"), F.least(F.lit(8), (attempt / 4).cast("int"))), F.sha2(digest.cast("binary"), 256))).otherwise("")
    bank = F.concat(F.substring(form, 1, 2), F.substr(like(form, digest), F.lit(3), F.length(form)))
    phone = F.concat(letter(digest, F.lit(1), "123456789"), F.substr(like(form, digest), F.lit(2), F.length(form)), longer)
    hexadecimal = F.array_join(F.transform(F.sequence(F.lit(1), F.length(form)), lambda i: F.when(F.substr(form, i, F.lit(1)) == ":", ":").otherwise(letter(digest, i * 3, "0123456789abcdef"))), "")
    whole = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.substr(digest, i * 4 + 1, F.lit(4))), ":")
    address6 = F.when(attempt > 3, whole).otherwise(hexadecimal)
    drawn = F.conv(F.substring(digest, 1, 7), 16, 10).cast("int")
    # from 1900 to 2099, and in wider draws from 1000 to 9999
    day = F.when(attempt > 3, F.date_add(F.lit("1000-01-01").cast("date"), drawn % 3_287_182)).otherwise(F.date_add(F.lit("1900-01-01").cast("date"), drawn % 73_000))
    date = F.when(form.contains("-"), F.date_format(day, "yyyy-MM-dd")).otherwise(F.concat(like(form, digest), longer))
    return F.when(kind == "mail", mail).when(kind == "address6", address6).when(kind == "born", date).when(kind == "address", address).when(kind == "phone", phone).when(kind == "card", card).when(kind.isin("first", "last"), name).when(kind == "bank", bank).otherwise(F.concat(like(form, digest), longer))


def dressed(kind: Column, found: Column, made: Column) -> Column:
    """The surrogate in the shape of the place: its separators, the digits before a telephone number's own; what is longer goes behind."""
    n_own = F.length(F.regexp_replace(found, "[^0-9A-Z]", ""))
    before = F.greatest(n_own - F.length(made), F.lit(0))
    place = F.sequence(F.lit(1), F.length(found))
    signs = F.transform(place, lambda i: F.substr(found, i, F.lit(1)))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, c: Column) -> Column:
        own = c.rlike("[0-9A-Z]")
        return F.struct(F.when(own, acc["at"] + 1).otherwise(acc["at"]).alias("at"), F.concat(acc["out"], F.when(own & (acc["at"] >= before), F.substr(made, acc["at"] - before + 1, F.lit(1))).otherwise(c)).alias("out"))

    filled = F.concat(F.aggregate(signs, zero, step, lambda acc: acc["out"]), F.substr(made, n_own - before + 1, F.length(made)))
    day = F.try_to_date(made, "yyyy-MM-dd")
    written = F.when(found.rlike(r"\d-\d"), made).when(found.contains("/"), F.date_format(day, "dd/MM/yyyy")).otherwise(F.date_format(day, "dd.MM.yyyy"))
    birth = F.concat(F.regexp_replace(found, f"{DATE}$", ""), F.coalesce(written, made))
    return F.when(kind.isin("mail", "address", "address6", "first", "last"), made).when(kind == "born", birth).otherwise(filled)


def distinct_surrogates(entities: DataFrame, key: str, draws: int = 16) -> DataFrame:
    """``kind, form, made`` for distinct ``kind, form`` (with ``sex``, of first names): no two entities share a surrogate and none is an entity.

    After ``draws`` keyed draws the entities that still clash are numbered, each round with numbers that no round before has used.
    """
    tasks = spread(entities.sparkSession)
    # digests are dear and rows few: they are dealt to all tasks
    fresh = lambda df, n: df.repartition(tasks, "kind", "form").select("kind", "form", surrogate(F.col("kind"), F.col("form"), F.col("sex"), key, F.lit(n)).alias("made"))
    now, attempt, used = stage(fresh(entities, 0), "surrogates"), 0, 0
    while True:
        real = entities.select("kind", F.col("form").alias("made"), F.lit(True).alias("real"))
        owners = now.groupBy("kind", "made").agg(F.min("form").alias("owner"), F.count(F.lit(1)).alias("n"))
        clash = now.join(owners, ["kind", "made"]).join(real, ["kind", "made"], "left").where("real or (n > 1 and form <> owner)").select("kind", "form")
        clash = stage(clash, "clashes")
        if clash.isEmpty():
            return now
        attempt += 1
        if attempt < draws:
            again = fresh(clash.join(entities, ["kind", "form"]), attempt)
        else:
            again = numbered(clash, [F.col("kind"), F.col("form")], "numbered").select("kind", "form", numbered_surrogate(F.col("kind"), F.col("form"), F.col("position") + used).alias("made"))
            used += clash.count()
        after = stage(now.join(clash, ["kind", "form"], "left_anti").unionByName(again), "surrogates")
        discard(now, clash)
        now = after


def replaced(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with entities in ``text`` replaced, and the column ``n_entities``: how many were.

    Who has ``key`` can tell surrogates from chance, so it is the caller's secret. If ``docs`` has a column ``n_entities`` that
    one stays and the count's name gets an underscore.

    Texts without entities stay as they are; null and empty texts stay and have 0. Rows that repeat are treated alike, with equal
    surrogates; all columns stay and other columns of any name do not matter; a null ``doc_id`` stays null. An empty table
    gives no rows.
    """
    columns, count = docs.columns, free_name("n_entities", docs.columns)
    hit = F.coalesce(F.col("text").rlike(HINT), F.lit(False)) & F.coalesce(F.col("text").rlike(ANY), F.lit(False))
    clean = docs.where(~hit).select(*columns, F.lit(0).cast("long").alias(count))
    own = docs.where(hit).select(F.struct(*columns).alias("row"), between(F.col("text"), ANY).alias("between"), matched(F.col("text"), ANY).alias("found"))
    own = stage(own.withColumn("n", F.monotonically_increasing_id()), "entities")
    each = own.select("n", F.posexplode("found").alias("at", "found")).select("n", "at", F.explode(parts(F.col("found"))).alias("p")).select("n", "at", "p.*").withColumn("form", canonical(F.col("kind"), F.col("found")))
    each = stage(each, "found")
    sex = F.when(F.min("sex") == F.max("sex"), F.min("sex")).otherwise("any").alias("sex")
    entities = stage(each.groupBy("kind", "form").agg(F.count(F.lit(1)).alias("times"), sex), "distinct")
    made = distinct_surrogates(entities.select("kind", "form", "sex"), key).join(entities.drop("sex"), ["kind", "form"])
    placed = F.struct("at", "part", F.concat("before", dressed(F.col("kind"), F.col("found"), F.col("made"))).alias("new"), "ends").alias("r")
    new = joined(each.drop("sex"), made, ["kind", "form"], "times").select("n", placed)
    per_text = new.groupBy("n").agg(F.array_sort(F.collect_list("r")).alias("new"))  # as many as the text has
    done = own.join(per_text, "n")
    text = F.concat(F.element_at("between", 1), F.array_join(F.transform("new", lambda r: F.concat(r["new"], F.when(r["ends"], F.get(F.col("between"), r["at"] + 1)).otherwise(""))), ""))
    done = done.select(*[text.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in columns], F.size("found").cast("long").alias(count))
    if "n_chars" in columns:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.unionByName(done)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replaced(docs_text(spark.read.parquet(f"{sf_dir}/documents.parquet")), key_of(spark))
