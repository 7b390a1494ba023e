"""Surrogates for personal data, in DataFrame functions alone.

Mentions of e-mail addresses, phone numbers, IPv4 addresses, card-like numbers and titled names are
found by one expression. Each comes down to parts with a canonical form (lower case; digits alone for
phones), so differently written mentions of one entity agree. A part's surrogate is drawn from SHA-512
over (key, kind, attempt, canonical form): letters become letters of the same script, digits digits;
phones keep country code and layout, addresses their network class, valid card numbers a valid check
digit; names get syllables of the same script. A given name's ending follows the gender of most of its
titles in the whole corpus, so one name keeps one surrogate whatever title stands before it. All different parts
of the corpus are compared: where two draw the same surrogate, or one that is itself a real value, the
later draws again, and what is drawn grows with the attempts (longer mail names, more syllables, wider private
networks), so small spaces don't run out. So surrogates stay distinct, and one entity keeps one surrogate in every document.
The drawn form is then laid into each mention's own format and case. Parts of a titled name are also replaced where
they stand alone, without a title, in the same document.

A hot entity is one row of the entity table; documents join it by entity with one row for each document
and mention, which the planner splits if it is hot. Texts move once, by document.

Edge cases: null texts stay null; empty texts and texts without mentions are unchanged; repeated rows
change alike; rows of one id and different texts share their names; an empty table gives an empty result; extra
columns are kept, except that n_entities replaces one of that name.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalog.llm.common import beside, discard, documents, materialize

KEY = "surrogates-1"
# Titles by gender.
MALE = ("Mr", "Herr", "Monsieur", "Señor", "Signor", "Господин", "Κύριος")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mademoiselle", "Señora", "Signora", "Госпожа", "Κυρία")
OTHER = ("Dr", "Prof")
TITLES = "|".join(sorted(MALE + FEMALE + OTHER, key=len, reverse=True))
EMAIL = r"(?<![\p{L}0-9._%+-])[\p{L}0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
IP = rf"(?<![0-9.])(?:{OCTET}\.){{3}}{OCTET}(?![0-9]|\.[0-9])"
PHONE = r"(?<![0-9+])\+?[0-9]{1,3}[ .-]?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])|(?<![0-9+])\+[0-9]{1,3}(?:[ .-][0-9]{2,4}){2,4}(?![0-9])"
# National numbers of ten digits, without a country code.
PHONE += r"|(?<![0-9+.-])(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[.-])[0-9]{3}[ .-][0-9]{4}(?![0-9]|[.-][0-9])"
CARD = r"(?<![0-9.])[0-9]{4}(?:[ -]?[0-9]{4}){3}(?![0-9])|(?<![0-9.])[0-9]{13,19}(?![0-9])"
NAME = rf"(?<!\p{{L}})(?:{TITLES})\.? \p{{Lu}}\p{{L}}++(?: \p{{Lu}}\p{{L}}++)?"
ANY = f"{EMAIL}|{IP}|{PHONE}|{CARD}|{NAME}"
ROUNDS = 16
#: Attempt from which a surrogate may be a real value elsewhere: it stays distinct, which nothing but that leaves room for.
CROWDED = 10


def mentions(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(ANY), F.lit(0))


def kind_of(m: Column) -> Column:
    return F.when(m.rlike(f"^(?:{EMAIL})$"), "email").when(m.rlike(f"^(?:{IP})$"), "ip").when(m.rlike(f"^(?:{NAME})$"), "name").when(m.rlike(f"^(?:{CARD})$"), "card").otherwise("phone")


def script_of(t: Column) -> Column:
    return F.when(t.rlike(r"^\p{IsCyrillic}"), "c").when(t.rlike(r"^\p{IsGreek}"), "g").otherwise("l")


def parts(m: Column) -> Column:
    """Array of (kind, canon, token, gender); a part with null kind stays as it is. gender: 1 male, -1 female by the title."""
    tok = F.split(m, " ")
    title = F.regexp_replace(F.element_at(tok, 1), r"\.$", "")
    gender = F.when(title.isin(*MALE), 1).when(title.isin(*FEMALE), -1).otherwise(0)
    piece = lambda kind, canon, token, gender=F.lit(0): F.struct(kind.alias("kind"), canon.alias("canon"), token.alias("token"), gender.alias("gender"))
    first, second = F.element_at(tok, 2), F.get(tok, F.lit(2))
    lone = lambda t: piece(F.concat(F.lit("surname_"), script_of(t)), F.lower(t), t)
    given = piece(F.concat(F.lit("given_"), script_of(first)), F.lower(first), first, gender)
    name = F.concat(F.array(piece(F.lit(None).cast("string"), F.lit(""), F.element_at(tok, 1))), F.when(second.isNull(), F.array(lone(first))).otherwise(F.array(given, lone(second))))
    kind = kind_of(m)
    canon = F.when(kind.isin("phone", "card"), F.regexp_replace(m, "[^0-9]", "")).otherwise(F.lower(m))
    return F.when(kind == "name", name).otherwise(F.array(piece(kind, canon, m)))


def draw(key: str, kind: Column, canon: Column, attempt: Column, gender: Column) -> Column:
    """Surrogate of a canonical form; later attempts draw from larger spaces."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), kind, attempt.cast("string"), canon), 512)
    byte = lambda i: F.conv(F.substr(digest, (i % 32) * 4 + 1, F.lit(4)), 16, 10).cast("int")
    pick = lambda letters, i: F.substr(F.lit(letters), byte(i) % len(letters) + 1, F.lit(1))
    chars = F.split(canon, "")
    like = lambda keep: F.array_join(F.transform(chars, lambda c, i: F.when(i < keep, c).when(c.rlike("[0-9]"), (byte(i) % 10).cast("string")).when(c.rlike(r"\p{IsCyrillic}"), pick("абвгдежзиклмнопрстуфхцчш", i)).when(c.rlike(r"\p{IsGreek}"), pick("αβγδεζηθικλμνξοπρστυφχψω", i)).when(c.rlike(r"\p{L}"), pick("abcdefghijklmnopqrstuvwxyz", i)).otherwise(c)), "")
    # E-mail: the part before @ and the first host label change; the rest of the host is kept.
    at = F.instr(canon, "@")
    host = F.substr(canon, at + 1)
    label = F.substring_index(host, ".", 1)
    more = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(attempt - 1, F.lit(1))), lambda i: pick("abcdefghijklmnopqrstuvwxyz", i + 7)), "")
    email = F.concat(F.substr(like(F.lit(0)), F.lit(1), at - 1), F.when(attempt >= 2, more).otherwise(""), F.lit("@"), F.substr(like(F.lit(0)), at + 1, F.length(label)), F.substr(host, F.length(label) + 1))
    octet = lambda i: (byte(F.lit(i)) % 254 + 1).cast("string")
    # Networks: 10/8, 172.16/12, 192.168/16, 127/8, 169.254/16, others. Crowded small ones give way to 10/8, that one to the whole.
    net = F.when(canon.startswith("10."), "10").when(canon.rlike(r"^172\.(?:1[6-9]|2[0-9]|3[01])\."), "172").when(canon.startswith("192.168."), "192").when(canon.startswith("169.254."), "169").when(canon.startswith("127."), "127").otherwise("")
    net = F.when(net.isin("172", "192", "169") & (attempt >= 4), "10").otherwise(net)
    net = F.when((net == "10") & (attempt >= CROWDED), "").otherwise(net)
    second = F.when(net == "172", (byte(F.lit(1)) % 16 + 16).cast("string")).when(net == "192", "168").when(net == "169", "254").otherwise(octet(1))
    ip = F.concat_ws(".", F.when(net == "", (byte(F.lit(0)) % 180 + 11).cast("string")).otherwise(net), second, octet(2), octet(3))
    # Phones keep the digits before the last ten.
    phone = like(F.greatest(F.length(canon) - 10, F.lit(0)))
    plain = like(F.lit(1))
    card = F.when(luhn(canon) == 0, fixed_check_digit(plain)).otherwise(plain)
    count = 3 + F.floor(attempt / 3)
    word = lambda cons, vow, tail: F.concat(F.array_join(F.transform(F.sequence(F.lit(0), (count - 1).cast("int")), lambda i: F.concat(pick(cons, 2 * i), pick(vow, 2 * i + 1))), ""), tail)
    ending = lambda f, m, s: F.when(kind.startswith("surname"), s).when(gender < 0, f).when(gender > 0, m).otherwise("")
    name = F.when(kind.endswith("_c"), word("бвгдклмнпрст", "аеиоу", ending("на", "слав", "ко"))).when(kind.endswith("_g"), word("βγδκλμνπρστ", "αειο", ending("να", "νος", "ης"))).otherwise(word("bdfgklmnprstv", "aeiou", ending("na", "ro", "son")))
    return F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "phone", phone).when(kind == "card", card).otherwise(name)


def luhn(digits: Column) -> Column:
    """Sum of the Luhn rule modulo 10; 0 for a valid number."""
    d = F.reverse(F.transform(F.split(digits, ""), lambda c: c.cast("int")))
    return F.aggregate(F.transform(d, lambda x, i: F.when(i % 2 == 0, x).otherwise(2 * x - F.when(x > 4, 9).otherwise(0))), F.lit(0), lambda a, x: a + x) % 10


def fixed_check_digit(digits: Column) -> Column:
    zero = F.concat(F.substr(digits, F.lit(1), F.length(digits) - 1), F.lit("0"))
    return F.concat(F.substr(digits, F.lit(1), F.length(digits) - 1), ((10 - luhn(zero)) % 10).cast("string"))


def surrogates(entities: DataFrame, key: str = KEY) -> DataFrame:
    """kind, canon, surrogate: distinct within a kind, and none a real value. entities: kind, canon, all different, and gender (optional)."""
    open_ = entities = entities if "gender" in entities.columns else entities.withColumn("gender", F.lit(0))
    done = None
    for r in range(ROUNDS):
        drawn = materialize(open_.withColumn("surrogate", draw(key, F.col("kind"), F.col("canon"), F.lit(r), F.col("gender"))), "drawn")
        free = drawn.groupBy("kind", "surrogate").agg(F.min("canon").alias("winner"))
        if r < CROWDED:
            free = free.join(entities.select("kind", F.col("canon").alias("surrogate")), ["kind", "surrogate"], "left_anti")
        if done is not None:
            free = free.join(done.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        won = drawn.join(free, ["kind", "surrogate"]).where("canon = winner").select("kind", "canon", "surrogate")
        won = materialize(won, "won")
        done = won if done is None else done.unionByName(won)
        last, open_ = open_, materialize(drawn.select("kind", "canon", "gender").join(won.select("kind", "canon"), ["kind", "canon"], "left_anti"), "open")
        discard(drawn, *([last] if r else []))
        if open_.isEmpty():
            return done
    raise RuntimeError("surrogates still collide: the corpus holds nearly all values that a kind's form allows")


def laid_out(kind: Column, token: Column, surrogate: Column) -> Column:
    """The surrogate in the mention's own format and case."""
    chars = F.split(token, "")
    seen = lambda i: F.length(F.regexp_replace(F.substr(token, F.lit(1), i + 1), "[^0-9]", ""))
    digits = F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike("[0-9]"), F.substr(surrogate, seen(i), F.lit(1))).otherwise(c)), "")
    cased = F.when(token.rlike(r"\p{L}") & (F.upper(token) == token) & (F.length(token) > 1), F.upper(surrogate)).when(token.rlike(r"^\p{Lu}"), F.concat(F.upper(F.substr(surrogate, F.lit(1), F.lit(1))), F.substr(surrogate, F.lit(2)))).otherwise(surrogate)
    return F.when(kind.isin("phone", "card"), digits).otherwise(cased)


#: Cuts between a letter and none.
WORD_EDGE = r"(?<=\p{L})(?!\p{L})|(?<!\p{L})(?=\p{L})"


def replace_pii(docs: DataFrame, key: str = KEY, id_col: str = "doc_id") -> DataFrame:
    """docs with text rewritten and n_entities (mentions replaced) added."""
    # Rows without an id go by their text.
    ident = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text "), F.xxhash64("text").cast("string")))
    found = docs.select(ident.alias("id"), F.explode(F.array_distinct(mentions(F.col("text")))).alias("mention"))
    each = materialize(found.distinct().select("id", "mention", F.posexplode(parts(F.col("mention"))).alias("place", "p")).select("id", "mention", "place", "p.*"), "mentions")
    entities = each.where("kind is not null").groupBy("kind", "canon").agg(F.sum("gender").alias("gender"))
    table = surrogates(materialize(entities, "entities"), key)
    put = each.join(table, ["kind", "canon"], "left").withColumn("new", F.when(F.col("kind").isNull(), F.col("token")).otherwise(laid_out(F.col("kind"), F.col("token"), F.col("surrogate"))))
    # A name's parts by themselves, for mentions without a title; one-letter parts are initials and stay.
    name = F.when((F.col("kind").startswith("given") | F.col("kind").startswith("surname")) & (F.length("token") > 1), F.struct("token", "new"))
    whole = put.groupBy("id", "mention").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "new"))), lambda x: x["new"]), " ").alias("new"), F.collect_set(name).alias("names"))
    # A token that is both a given name and a surname here takes the smaller surrogate.
    names = F.aggregate(F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))), F.array().cast("array<struct<token:string,new:string>>"), lambda a, x: F.when((F.size(a) > 0) & (F.try_element_at(a, F.lit(-1))["token"] == x["token"]), a).otherwise(F.concat(a, F.array(x))))
    maps = whole.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("mention", "new"))).alias("__pii_map"), F.map_from_entries(names).alias("__pii_names"))
    joined = docs.join(maps.withColumnRenamed("id", "__pii_id"), ident == F.col("__pii_id"), "left")
    on = F.col("__pii_map").isNotNull()
    staged = joined.select("*", F.when(on, mentions(F.col("text"))).alias("__pii_found"), F.when(on, F.split("text", ANY, -1)).alias("__pii_gaps"))
    words = F.transform("__pii_gaps", lambda g: F.split(g, WORD_EDGE))
    known = lambda w: F.map_contains_key(F.col("__pii_names"), w)
    alone = F.when(F.size(F.map_keys("__pii_names")) > 0, F.aggregate(words, F.lit(0), lambda a, ws: a + F.size(F.filter(ws, known)))).otherwise(0)
    renamed = F.transform(words, lambda ws: F.array_join(F.transform(ws, lambda w: F.coalesce(F.try_element_at(F.col("__pii_names"), w), w)), ""))
    gaps = F.when(F.size(F.map_keys("__pii_names")) > 0, renamed).otherwise(F.col("__pii_gaps"))
    rebuilt = F.array_join(F.zip_with(gaps, F.transform("__pii_found", lambda m: F.element_at(F.col("__pii_map"), m)), lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))), "")
    text = F.when(on & F.col("text").isNotNull(), rebuilt).otherwise(F.col("text")).alias("text")
    count = F.when(on & F.col("text").isNotNull(), F.size("__pii_found") + alone).otherwise(0).cast("long").alias("n_entities")
    return staged.select(*[text if c == "text" else F.col(f"`{c}`") for c in beside(docs, "n_entities")], count)


def op3_pii(spark, sf_dir: str) -> DataFrame:
    return replace_pii(documents(spark, sf_dir).select("doc_id", "text"))
