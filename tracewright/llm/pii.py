"""Surrogates for personal data: keyed, type-consistent, distinct, the same for one entity.

All of it is DataFrame work. A mention keeps its format (separators, case, prefix);
its canonical form is the entity; the entity's surrogate is drawn by a keyed hash
over (type, entity, attempt). A check over all entities of the corpus sends those
whose surrogate is taken, or is itself a real entity, to their next attempt.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import full_text
from tracewright.scale import checkpoint

OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
DOCTOR = r"(?:Dr|Doctor|Doktor|Docteur|доктор)"
PROFESSOR = r"(?:Prof|Professor|Professorin|Professeure?|Profesora?|профессор)"
LEARNED = rf"(?:\.? (?:{DOCTOR}|{PROFESSOR})){{0,2}}"  # between a title and its name
MEN = r"(?:Mr|Mister|Sir|Lord|Herrn?|Hr|Monsieur|M|Señor|Sr|Don|г-н|господин)" + LEARNED
WOMEN = r"(?:Mrs|Ms|Miss|Madam|Lady|Frau|Madame|Mme|Mademoiselle|Mlle|Señora|Señorita|Sra|Srta|Doña|г-жа|госпожа)" + LEARNED
ONE_NAME = r"\.? \p{Lu}\p{Ll}+"
NAMES = ONE_NAME + r"(?:[ -]\p{Lu}\p{Ll}+){0,2}(?!\p{L})"
# Who bears a learned title alone; after a doctor's two names at least, as "Dr Who" is left.
PERSON = f"(?:{PROFESSOR}{LEARNED}|{DOCTOR}{LEARNED}(?={ONE_NAME}[ -]\\p{{Lu}}\\p{{Ll}}))"
WORD = r"(?<![\p{L}\p{N}])"
SECRET = r"(?i:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)"
HEX = "[0-9A-Fa-f]{1,4}"

# One entity type per pattern; earlier ones win. A pattern holds no capturing group.
PATTERNS: dict[str, str] = {
    "secret": WORD + SECRET + r"[\"']?\s{0,3}[:=]\s{0,3}[\"']?"
              r"(?:(?=[^\s\"',;]*\d)[^\s\"',;!?*#&%$|]{6,}|[^\s\"',;!?*#&%$|]{8,})",
    "key": WORD + r"(?:AKIA|ASIA)[0-9A-Z]{16}(?![\p{L}\p{N}])|" + WORD
           + r"(?:gh[pousr]_|sk-|pk-|xox[abp]-)[A-Za-z0-9_-]{16,}",
    "email": r"(?<![\p{L}\p{N}._+-])[\p{L}\p{N}][\p{L}\p{N}._+-]*+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+){0,20}\.\p{L}{2,}",
    "ip": r"(?<![\p{L}\p{N}.])" + OCTET + r"(?:\." + OCTET + r"){3}(?![\p{L}\p{N}]|\.\d)",
    # Compressed ones hold a digit, or a group of three, unlike most paths of program names.
    "ip6": rf"(?<![\p{{L}}\p{{N}}:])(?:(?:{HEX}:){{7}}{HEX}|(?=[0-9A-Fa-f:]*(?:\d|[0-9A-Fa-f]{{3}}))"
           rf"(?:(?:{HEX}:){{1,6}}(?::{HEX}){{1,6}}|(?:{HEX}:){{1,7}}:|:(?::{HEX}){{1,7}}))(?![\p{{L}}\p{{N}}:])",
    "iban": WORD + r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "card": r"(?<![\p{L}\p{N}+.-])(?:\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}|\d{4}[ -]?\d{6}[ -]?\d{5})(?![\p{L}\p{N}])",
    "ssn": r"(?<![\p{L}\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}-])",
    "phone": r"(?<![\p{L}\p{N}+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}"
             r"|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\p{L}\p{N}])",
    "man": WORD + MEN + NAMES,
    "woman": WORD + WOMEN + NAMES,
    "person": WORD + PERSON + NAMES,
}
NAMED = ("man", "woman", "person")
TITLES = f"(?:{MEN}|{WOMEN}|{PERSON})"
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
# What each mention holds: a digit, an @, a title before a name, or the sign of a secret, key or ip6.
HINT = (r"\d|@|" + WORD + TITLES + r"\.? \p{Lu}|" + SECRET + r"[\"']?\s{0,3}[:=]"
        r"|AKIA|ASIA|gh[pousr]_|sk-|pk-|xox[abp]-|[0-9A-Fa-f]:[0-9A-Fa-f]|::")

MARK = "\ufdd0"  # no character: Unicode keeps it for inner use

LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
CYRILLIC = "".join(map(chr, range(0x430, 0x450)))

GIVEN = {
    "man": {
        "latin": ["Adrian", "Bruno", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl",
                  "Leon", "Martin", "Noah", "Oskar", "Paul", "Ralf", "Simon", "Theo", "Viktor"],
        "cyrillic": ["Антон", "Борис", "Вадим",
                     "Глеб", "Егор", "Игорь",
                     "Олег", "Павел", "Роман"],
    },
    "woman": {
        "latin": ["Alma", "Berta", "Clara", "Diana", "Elena", "Flora", "Greta", "Helena", "Irma", "Julia", "Karla",
                  "Laura", "Maria", "Nora", "Olga", "Paula", "Rosa", "Sara", "Tilda", "Vera"],
        "cyrillic": ["Анна", "Вера", "Дина", "Елена",
                     "Ирина", "Ольга", "Полина",
                     "Раиса", "Таисия"],
    },
}
GIVEN["any"] = {"latin": GIVEN["man"]["latin"] + GIVEN["woman"]["latin"]}
# Surnames are built from syllables; each attempt adds one, so they never run out.
SYLLABLES = {
    "latin": ["ba", "del", "fen", "gor", "hal", "kar", "lin", "mor", "nel", "par", "ros", "sten", "tal", "ver", "win", "zan"],
    "cyrillic": ["ба", "вер", "гор", "дан", "кар",
                 "лин", "мор", "нел", "рос", "тал"],
}
SURNAME_END = {"latin": {"man": "", "woman": ""}, "cyrillic": {"man": "ов", "woman": "ова"}}


def split_mentions(text: Column) -> Column:
    """Text and mentions in turns: text, mention, text ..., a text at both ends; null if no sign of one is there.

    One pass of the patterns: each match is put between marks, and the marks are cut at.
    A text that holds the mark itself is gone over twice instead.
    """
    marked = F.split(F.regexp_replace(text, ANY, f"{MARK}$0{MARK}"), MARK, -1)
    gaps, found = F.split(text, ANY, -1), F.regexp_extract_all(text, F.lit(ANY), 0)
    twice = F.slice(F.flatten(F.zip_with(gaps, found, lambda a, b: F.array(a, b))), F.lit(1), F.size(gaps) * 2 - 1)
    return F.when(text.rlike(HINT), F.when(F.contains(text, F.lit(MARK)), twice).otherwise(marked))


def kind_of(mention: Column) -> Column:
    found = F.lit(None).cast("string")
    for name, pattern in reversed(PATTERNS.items()):
        found = F.when(mention.rlike(f"^(?:{pattern})$"), name).otherwise(found)
    return found


def _prefix(kind: Column, mention: Column) -> Column:
    """The part of a mention that stays: the name of a secret, a title."""
    return F.when(kind == "secret", F.regexp_extract(mention, "^(" + SECRET + r"[\"']?\s{0,3}[:=]\s{0,3}[\"']?)", 1)).when(
        kind.isin(*NAMED), F.regexp_extract(mention, rf"^{TITLES}\.? ", 0)).otherwise("")


def parts_of(mention: Column) -> Column:
    """Array of (kind, entity, raw, before): what to replace in a mention and what stands before it.

    A name has one part per word: its last word is a surname, which has the gender of
    the title only in Cyrillic; the others are given names. Behind a learned title alone
    a Cyrillic name has the gender of its end, another one has none.
    """
    kind = kind_of(mention)
    before = _prefix(kind, mention)
    rest = F.substr(mention, F.char_length(before) + 1)
    plain = F.when(kind == "email", F.lower(rest)).when(
        kind.isin("card", "ssn", "iban"), F.regexp_replace(rest, "[^0-9A-Za-z]", "")).when(
        kind == "phone", F.regexp_replace(rest, "[^0-9+]", "")).when(kind == "ip6", F.lower(rest)).otherwise(rest)
    one = F.array(F.struct(kind.alias("kind"), plain.alias("entity"), rest.alias("raw"), before.alias("before")))
    words = F.split(rest, "[ -]")
    def name_part(word: Column, i: Column) -> Column:
        script = F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")
        last = i == F.size(words) - 1
        shown = F.when(word.rlike("[ая]$"), "woman").when(script == "cyrillic", "man").otherwise("any")
        gender = F.when(kind != "person", kind).otherwise(shown)
        role = F.when(last & (script == "latin"), F.lit("surname latin any")).when(
            last, F.concat(F.lit("surname cyrillic "), gender)).otherwise(F.concat_ws(" ", F.lit("given"), script, gender))
        between = F.when(i == 0, before).otherwise(
            F.substr(rest, F.char_length(F.array_join(F.slice(words, 1, i), " ")) + 1, F.lit(1)))
        return F.struct(role.alias("kind"), word.alias("entity"), word.alias("raw"), between.alias("before"))

    return F.when(kind.isin(*NAMED), F.transform(words, name_part)).otherwise(one)


def _pick(letters: str, seed: Column, i: Column) -> Column:
    return F.substr(F.lit(letters), F.pmod(F.xxhash64(seed, i), F.lit(len(letters))).cast("int") + 1, F.lit(1))


def _letters(text: Column, seed: Column, keep: int = 0, hexes: bool = False) -> Column:
    """Each digit and letter after the first ``keep`` drawn anew within its own kind and script."""
    def draw(i: Column) -> Column:
        c = F.substr(text, i, F.lit(1))
        low, up = ("abcdef", "ABCDEF") if hexes else (LOWER, UPPER)
        return F.when((i <= keep) | ~c.rlike(r"[\p{L}\p{N}]"), c).when(c.rlike("[0-9]"), _pick(DIGITS, seed, i)).when(
            c.rlike(r"\p{IsCyrillic}"), _pick(CYRILLIC, seed, i)).when(
            c.rlike(r"\p{Lu}"), _pick(up, seed, i)).otherwise(_pick(low, seed, i))

    places = F.when(F.char_length(text) > 0, F.sequence(F.lit(1), F.char_length(text))).otherwise(F.array().cast("array<int>"))
    return F.array_join(F.transform(places, draw), "")


def _luhn(digits: Column) -> Column:
    """Luhn sum modulo 10."""
    n = F.char_length(digits)

    def weigh(i: Column) -> Column:
        d = F.substr(digits, i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when((n - i) % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), weigh), F.lit(0), lambda a, b: a + b) % 10


def _card(entity: Column, seed: Column) -> Column:
    """Digits after the first drawn anew; valid by Luhn if the entity is."""
    drawn = _letters(entity, seed, keep=1)
    body = F.substr(drawn, F.lit(1), F.char_length(drawn) - 1)
    check = (F.lit(10) - _luhn(F.concat(body, F.lit("0")))) % 10
    return F.when(_luhn(entity) == 0, F.concat(body, check.cast("string"))).otherwise(drawn)


def _surname(script: str, gender: str, seed: Column, attempt: Column) -> Column:
    parts = F.array(*map(F.lit, SYLLABLES[script]))
    drawn = F.transform(F.sequence(F.lit(1), attempt + 3), lambda i: F.get(parts, F.pmod(F.xxhash64(seed, i), F.lit(len(SYLLABLES[script]))).cast("int")))
    return F.concat(F.initcap(F.array_join(drawn, "")), F.lit(SURNAME_END[script].get(gender, "")))


def _given(script: str, gender: str, seed: Column, attempt: Column) -> Column:
    """A name of the list; from the second attempt on, joined by a hyphen to further ones."""
    names = F.array(*map(F.lit, GIVEN[gender][script]))
    size = len(GIVEN[gender][script])
    drawn = F.transform(F.sequence(F.lit(0), attempt), lambda i: F.get(names, F.pmod(F.xxhash64(seed, i), F.lit(size)).cast("int")))
    return F.array_join(drawn, "-")


def surrogate(kind: Column, entity: Column, attempt: Column, secret: str) -> Column:
    """The surrogate of an entity at an attempt, under a key."""
    seed = F.sha2(F.concat_ws("\x01", F.lit(secret), kind, entity, attempt.cast("string")), 256)
    octet = [F.pmod(F.xxhash64(seed, F.lit(i)), F.lit(m)).cast("int") + low for i, (m, low) in enumerate(((223, 1), (256, 0), (256, 0), (254, 1)))]
    local, host = F.substring_index(entity, "@", 1), F.substring_index(entity, "@", -1)
    host = F.regexp_replace(host, r"\.\p{L}+$", "")
    out = F.when(kind == "email", F.concat(_letters(local, seed), F.lit("@"), _letters(host, F.sha2(seed, 256)), F.lit(".example")))
    out = out.when(kind == "ip", F.concat_ws(".", *[o.cast("string") for o in octet]))
    out = out.when(kind == "card", _card(entity, seed)).when(kind == "ssn", F.concat(F.lit("9"), F.substr(_letters(entity, seed), F.lit(2))))
    out = out.when(kind == "phone", _letters(entity, seed, keep=2)).when(kind == "iban", _letters(entity, seed, keep=2))
    out = out.when(kind == "key", _letters(entity, seed, keep=4)).when(kind == "ip6", _letters(entity, seed, hexes=True))
    for role, by in (("given", _given), ("surname", _surname)):
        for script in ("latin", "cyrillic"):
            for gender in ("any",) if (role, script) == ("surname", "latin") else ("man", "woman", "any") if script == "latin" else ("man", "woman"):
                out = out.when(kind == f"{role} {script} {gender}", by(script, gender, seed, attempt))
    return out.when(entity.rlike("^[0-9a-fA-F]+$"), _letters(entity, seed, hexes=True)).otherwise(_letters(entity, seed))


def _dress(kind: Column, raw: Column, drawn: Column) -> Column:
    """A surrogate in the format of a mention: its separators, its capitals."""
    def fill(i: Column) -> Column:
        at = F.char_length(F.regexp_replace(F.substr(raw, F.lit(1), i), "[^0-9A-Za-z+]", ""))
        c = F.substr(raw, i, F.lit(1))
        return F.when(c.rlike("[0-9A-Za-z+]"), F.substr(drawn, at, F.lit(1))).otherwise(c)

    filled = F.array_join(F.transform(F.sequence(F.lit(1), F.char_length(raw)), fill), "")
    loud = (kind == "email") & (raw == F.upper(raw)) & (raw != F.lower(raw))
    return F.when(kind.isin("card", "phone", "ssn", "iban"), filled).when(loud, F.upper(drawn)).otherwise(drawn)


def family(kind: Column) -> Column:
    """The kinds whose entities and surrogates must not meet: all parts of names are one family."""
    return F.when(kind.rlike("^(given|surname) "), F.lit("name")).otherwise(kind)


def assign(entities: DataFrame, secret: str) -> DataFrame:
    """kind, entity, attempt, drawn: a surrogate for each distinct (kind, entity).

    No two entities of a family of kinds share one and none is an entity of the corpus
    itself: of those that clash, the one settled first (least attempt, then least
    entity and kind) keeps it, the others draw again. Rounds go on until nothing clashes.
    """
    drawn = surrogate(F.col("kind"), F.col("entity"), F.col("attempt"), secret)
    parts = int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, much work: rows are dealt
    now = entities.repartition(parts, "kind", "entity").withColumn("attempt", F.lit(0)).withColumn("drawn", drawn)
    while True:
        now = checkpoint(now)
        mine = now.withColumn("f", family(F.col("kind")))
        first = mine.groupBy(F.col("f").alias("k"), F.col("drawn").alias("d")).agg(
            F.min(F.struct("attempt", "entity", "kind")).alias("first"), F.count("*").alias("n"))
        first = first.where("n > 1").select("k", "d", "first")
        real = mine.select(F.col("f").alias("rk"), F.col("entity").alias("rd")).distinct()
        seen = mine.join(first, (F.col("f") == F.col("k")) & (F.col("drawn") == F.col("d")), "left")
        seen = seen.join(real, (F.col("f") == F.col("rk")) & (F.col("drawn") == F.col("rd")), "left")
        clash = F.col("rd").isNotNull() | (
            F.col("first").isNotNull() & (F.struct("attempt", "entity", "kind") != F.col("first")))
        marked = seen.select(*now.columns, clash.alias("clash"))
        if marked.where("clash").isEmpty():
            return now
        now = marked.withColumn("attempt", F.col("attempt") + F.col("clash").cast("int")).select(
            "kind", "entity", "attempt", F.when(F.col("clash"), drawn).otherwise(F.col("drawn")).alias("drawn"))


@dataclass(frozen=True)
class Replaced:
    docs: DataFrame
    entities: DataFrame


def replace_personal_data(
    docs: DataFrame, secret: str, text_col: str = "text", count_col: str = "n_replaced",
) -> Replaced:
    """All rows and columns of ``docs`` with surrogates in the text, plus ``count_col``; and the entity table.

    An entity has one surrogate in the whole corpus, in every format it is written
    in. Texts without mentions, null and empty texts stay as they are; repeated rows
    get the same text; an empty table gives an empty one. Whole texts are read. Extra
    columns are kept (an own ``count_col`` is overwritten); ids play no part.

    A name of a text is also replaced where it stands there again without a title, by
    the surrogate of its first mention, word by word.

    The patterns go over a text once: rows with mentions are written as texts and
    mentions in turns, all later steps read these. Mentions are told once per distinct
    text, so copies are cheap, and are joined to their surrogates; the join back is on
    the text's digest, and Spark splits its hot side. Texts without mentions are not
    shuffled; a second pass picks them out.
    """
    turns = split_mentions(full_text(docs[text_col]))
    rows = docs.select(F.struct("*").alias("doc"), turns.alias("turns"))
    quiet = rows.where(F.coalesce(F.size("turns"), F.lit(0)) <= 1).select(
        "doc", F.col("doc")[text_col].alias("new"), F.lit(0).cast("long").alias("n"))
    bare = F.struct("*").withField(text_col, F.lit(None).cast("string"))
    found = docs.select(bare.alias("doc"), F.explode(F.filter(F.array(turns), lambda x: F.size(x) > 1)).alias("turns"))
    found = checkpoint(found.withColumn("digest", F.md5(F.array_join("turns", ""))))
    heard = F.filter("turns", lambda _, i: i % 2 == 1)
    lists = found.select("digest", heard.alias("m")).groupBy("digest").agg(F.first("m").alias("m"))
    flat = lists.select("digest", F.posexplode("m").alias("pos", "mention"))
    flat = checkpoint(flat.select("digest", "pos", F.posexplode(parts_of(F.col("mention"))).alias("k", "part")).select(
        "digest", "pos", "k", "part.*"))
    # A given name without a gender is that of a man or woman, if the corpus has one.
    kinds = flat.select(F.col("kind").alias("e_kind"), F.col("entity").alias("e")).distinct()
    gendered = kinds.where(F.col("e_kind").isin("given latin man", "given latin woman")).groupBy(F.col("e").alias("known")).agg(
        F.min("e_kind").alias("as"))
    kinds = checkpoint(kinds.join(gendered, (F.col("e_kind") == "given latin any") & (F.col("e") == F.col("known")), "left").select(
        "e_kind", "e", F.coalesce("as", "e_kind").alias("as")))
    entities = assign(kinds.select(F.col("as").alias("kind"), F.col("e").alias("entity")).distinct(), secret)
    names = kinds.join(entities, (F.col("as") == F.col("kind")) & (F.col("e") == F.col("entity"))).select("e_kind", "e", "drawn")
    is_name = F.col("kind").rlike("^(given|surname) ")
    told = flat.join(names, (F.col("kind") == F.col("e_kind")) & (F.col("entity") == F.col("e"))).select(
        "digest", "pos", "k", F.concat("before", _dress(F.col("kind"), F.col("raw"), F.col("drawn"))).alias("said"),
        F.when(is_name, F.struct(F.col("raw").alias("word"), "drawn")).alias("name"))
    told = told.groupBy("digest", "pos").agg(F.sort_array(F.collect_list(F.struct("k", "said", "name"))).alias("said"))
    told = told.select("digest", "pos", F.array_join(F.col("said.said"), "").alias("said"), F.col("said.name").alias("names"))
    told = told.groupBy(F.col("digest").alias("of")).agg(F.sort_array(F.collect_list(F.struct("pos", "said", "names"))).alias("said"))
    told = told.withColumn("names", F.filter(F.flatten("said.names"), lambda x: x.isNotNull()))
    back = found.join(told, F.col("digest") == F.col("of"))
    back = back.select("doc", "names", F.col("said.said").alias("said"), F.size("said").cast("long").alias("n"),
                       F.filter("turns", lambda _, i: i % 2 == 0).alias("gaps"))
    words = F.array_join(F.array_distinct("names.word"), "|")
    again = F.concat(F.lit(WORD + "(?:"), words, F.lit(r")(?![\p{L}\p{N}])"))
    back = back.withColumn("again", F.when(F.size("names") > 0, again))
    back = back.withColumn("hits", F.transform("gaps", lambda g: F.regexp_extract_all(g, F.col("again"), F.lit(0))))

    def repeats(gap: Column, hits: Column) -> Column:
        def put(a: Column, hit: Column) -> Column:
            at = F.array_position(F.col("names.word"), hit).cast("int") - 1
            return F.concat(a, F.coalesce(F.get(F.col("names.drawn"), at), F.lit("")))

        return F.when(F.size(hits) > 0, F.array_join(F.zip_with(F.split(gap, F.col("again"), -1), hits, put), "")).otherwise(gap)

    gaps = F.zip_with("gaps", "hits", repeats)
    woven = F.zip_with(gaps, "said", lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    more = F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + F.greatest(F.coalesce(F.size(h), F.lit(0)), F.lit(0)))
    back = back.select("doc", F.array_join(woven, "").alias("new"), (F.col("n") + more).alias("n"))
    out = quiet.unionByName(back).select(F.col("doc").withField(text_col, F.col("new")).withField(count_col, F.col("n")).alias("doc"))
    return Replaced(out.select("doc.*"), entities)

