"""PII: detected entities get keyed surrogates of their own type, in DataFrame functions only.

E-mail and IP addresses, phone, card, account and social security numbers and titled personal names are
found by one expression. A distinct value gets one surrogate over the whole corpus (coreference) and no two
values share one (distinctness): candidates come from a keyed SHA-256, those that collide with another
value's surrogate or with a real value are drawn again (given and family names share one space). A surrogate
keeps the type, the format (digits for digits, letters for letters, separators, case), a card's check digit,
a name's script and the gender of a given name: the one that most of its titles in the corpus tell, so that
one name has one surrogate whatever title it bears. The key (of an HMAC) never appears in the output.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _spark

#: Expressions of the entity types, in order of precedence where they begin at one place.
TITLES = {"m": "Mr|Herr|Monsieur|Señor|Sr|Don|Signor|г-н|господин", "f": "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Doña|Signora|г-жа|госпожа", "u": "Dr|Prof"}
#: Where no letter, digit or low line stands before or after; a word boundary would not know Cyrillic letters in all Java versions.
_BEFORE, _AFTER = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
TYPES = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "iban": rf"{_BEFORE}[A-Z]{{2}}[0-9]{{2}}(?: ?[0-9A-Z]{{4}}){{3,7}}(?: ?[0-9A-Z]{{1,3}})?{_AFTER}",
    "ip": rf"(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9]|\.[0-9])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{4}[ -]?){3}[0-9]{4}(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9])(?:\+[0-9]{1,3}[ .-]?)(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9])|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9-])",
    "name": rf"{_BEFORE}(?:{'|'.join(TITLES.values())})\.? \p{{Lu}}[\p{{Ll}}'’]+(?:[ -]\p{{Lu}}[\p{{Ll}}'’]+){{0,2}}",
}
MASTER = "|".join(f"(?:{x})" for x in TYPES.values())
#: What a text with any entity has: a digit group, digits around a dot, an at sign in a word or a title.
HINT = rf"[0-9]{{2}}|[0-9]\.[0-9]|[A-Za-z0-9._%+-]@[A-Za-z0-9-]|{_BEFORE}(?:{'|'.join(TITLES.values())})\.? \p{{Lu}}"
#: The calling codes of one and two digits; all others have three.
CALLING_CODE = "1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3}"
#: Given names by gender and script, and syllables of surnames by script (fixed values).
GIVEN = {
    ("m", "latin"): "James John Robert Michael David Thomas Daniel Paul Mark George Peter Lucas Martin Simon Victor Hugo Oscar Leon Felix Adrian".split(),
    ("f", "latin"): "Mary Anna Laura Sarah Emma Julia Alice Helen Clara Nora Marie Sophie Lucia Elena Irene Paula Diana Greta Olivia Rosa".split(),
    ("m", "cyrillic"): "Иван Пётр Павел Олег Игорь Антон Максим Борис Сергей Андрей".split(),
    ("f", "cyrillic"): "Анна Мария Ольга Елена Ирина Нина Вера Дарья Юлия Софья".split(),
}
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ha he ka ke ko la le lo ma me mo na ne no pa pe ra re ro sa so va".split(),
    "cyrillic": "ба бе бо да де до фа фе га го ха хе ка ке ко ла ле ло ма ме мо на не но па пе ра ре ро са со ва".split(),
}
#: Draws after which a surrogate may grow by a character or a syllable (given names grow from the third draw on), so
#: that names, phones and e-mails have room for any number of values.
GROW, ATTEMPTS = 6, 24
#: A value with at least so many occurrences, and at least one in so many of all, is hot: its surrogate is broadcast.
HOT, SHARE = 10_000, 10_000
_P = "_dfp_"


def _digest(key: str, attempt: int, *parts: str) -> Column:
    """HMAC-SHA-512 of the parts, in hex."""
    block = hashlib.sha512(key.encode()).digest() if len(key.encode()) > 128 else key.encode()
    block = block.ljust(128, b"\0")
    inner, outer = (F.lit(bytearray(x ^ pad for x in block)) for pad in (0x36, 0x5C))
    message = F.concat_ws("\u0001", *(F.col(p) for p in parts), F.lit(str(attempt))).cast("binary")
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 512))), 512)


def _number(digest: str, at: str, modulus: int) -> str:
    """SQL: a number below modulus from the digest's at-th pair of bytes (32 of them, then from the start again)."""
    return f"cast(conv(substring({digest}, 1 + 4 * (({at}) % 32), 4), 16, 10) as int) % {modulus}"


def _masked(value: str, digest: str) -> str:
    """SQL: letters for letters, digits for digits, other characters as they are."""
    letter = f"char(97 + {_number(digest, 'i', 26)})"
    return (
        f"array_join(transform(filter(split({value}, ''), x -> x <> ''), (x, i) -> case when x rlike '[0-9]' then cast({_number(digest, 'i', 10)} as string)"
        f" when x rlike '[a-z]' then {letter} when x rlike '[A-Z]' then upper({letter}) else x end), '')"
    )


def _luhn(digits: str) -> str:
    """SQL: the Luhn sum of a digit string, modulo 10 (0 for a valid one)."""
    doubled = "2 * cast(x as int) - case when cast(x as int) > 4 then 9 else 0 end"
    return f"aggregate(transform(filter(split(reverse({digits}), ''), y -> y <> ''), (x, i) -> case when i % 2 = 1 then {doubled} else cast(x as int) end), 0, (a, b) -> a + b) % 10"


def _syllables(script: str, digest: str, n: int, from_: int) -> str:
    pool = "array(" + ",".join(f"'{x}'" for x in SYLLABLES[script]) + ")"
    return "concat(" + ",".join(f"{pool}[{_number(digest, str(from_ + k), len(SYLLABLES[script]))}]" for k in range(n)) + ")"


def _surrogate(attempt: int) -> Column:
    """The candidate for columns (type, norm, gender, digest): see assign(). norm is in the form that _normal() gives."""
    d, extra = "digest", max(0, attempt - GROW)
    more = f"repeat(cast({_number(d, '31', 10)} as string), {extra})"
    domain = f"concat({_masked('regexp_extract(norm, ' + repr('@([^.]+)') + ', 1)', 'reverse(digest)')}, '.example.', array('com', 'net', 'org')[{_number(d, '30', 3)}])"
    email = f"concat({_masked('regexp_extract(norm, ' + repr('^([^@]+)') + ', 1)', d)}, {more}, '@', {domain})"
    ip = f"concat_ws('.', 1 + {_number(d, '0', 223)}, {_number(d, '1', 256)}, {_number(d, '2', 256)}, 1 + {_number(d, '3', 254)})"
    body = f"concat(substring(norm, 1, 1), substring({_masked('norm', d)}, 2, length(norm) - 2))"
    check = f"cast((10 - ({_luhn('concat(' + body + ', ' + repr('0') + ')')})) % 10 as string)"
    card = f"concat({body}, case when ({_luhn('norm')}) = 0 then {check} else cast({_number(d, '29', 10)} as string) end)"
    ssn = f"concat('9', substring({_masked('norm', d)}, 2))" if attempt < GROW else f"concat({_masked('norm', d)}, {more})"
    # country code, then a first digit of 2 to 9
    country, local = "substring_index(norm, '_', 1)", "substring_index(norm, '_', -1)"
    phone = f"concat({country}, '_', cast(2 + {_number(d, '28', 8)} as string), substring({_masked(local, d)}, 2), {more})"
    iban = f"concat(substring(norm, 1, 2), substring({_masked('norm', d)}, 3))"
    out = F.when(F.col("type") == "email", F.expr(email)).when(F.col("type") == "ip", F.expr(ip)).when(F.col("type") == "card", F.expr(card))
    out = out.when(F.col("type") == "ssn", F.expr(ssn)).when(F.col("type") == "phone", F.expr(phone)).when(F.col("type") == "iban", F.expr(iban))
    for script in SYLLABLES:
        n = 3 if attempt < GROW else 4 + attempt - GROW
        out = out.when(F.col("type") == f"surname_{script}", F.expr(f"initcap({_syllables(script, d, n, 0)})"))
        for gender in "mfu":
            pool = GIVEN.get((gender, script)) or GIVEN["m", script] + GIVEN["f", script]
            listed = "array(" + ",".join(f"'{x}'" for x in pool) + ")"
            drawn = f"{listed}[{_number(d, '7', len(pool))}]"
            # a pool is small: later draws add syllables, one more each time, which keep the name's ending
            grown = _syllables(script, d, 2, 0) + (f", {_syllables(script, d, attempt - 2, 8)}" if attempt > 2 else "")
            longer = f"initcap(concat({grown}, lower({drawn})))"
            out = out.when((F.col("type") == f"given_{script}") & (F.col("gender") == gender), F.expr(drawn if attempt < 2 else longer))
    return out


def assign(values: DataFrame, key: str) -> DataFrame:
    """(type, norm, surrogate) for distinct values(type, norm, gender): one each, no two alike within a space, none a real value of it.

    All names share a space, each other type has its own. gender (m, f, u) is that of given names.
    """
    space = F.when(F.col("type").rlike("^(given|surname)_"), "name").otherwise(F.col("type"))
    values = _spark.materialize(values.select("type", "norm", "gender", space.alias("space")), "values")
    todo, done = values, []
    for attempt in range(ATTEMPTS):
        drawn = todo.withColumn("digest", _digest(key, attempt, "type", "norm")).withColumn("surrogate", _surrogate(attempt))
        real = values.select("space", F.col("norm").alias("surrogate"))
        drawn = drawn.join(real, ["space", "surrogate"], "left_anti")
        for earlier in done:
            drawn = drawn.join(earlier.select("space", "surrogate"), ["space", "surrogate"], "left_anti")
        won = drawn.groupBy("space", "surrogate").agg(F.min(F.struct("type", "norm")).alias("won"))
        done.append(_spark.materialize(won.select("won.type", "won.norm", "space", "surrogate"), "surrogates"))
        todo = _spark.materialize(todo.join(done[-1], ["type", "norm"], "left_anti"), "values")
        if todo.isEmpty():
            break
    else:
        raise RuntimeError("some values found no surrogate of their own")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("type", "norm", "surrogate")


def _normal(kind: str, value: str) -> Column:
    """The value without its format: what two spellings of one entity share. A phone is its calling code, a low line and the
    rest of its digits; the formats without a calling code are those of +1."""
    v = F.col(value)
    digits = F.regexp_replace(v, "[^0-9]", "")
    code = F.when(v.startswith("+"), F.regexp_extract(digits, f"^({CALLING_CODE})", 1)).otherwise(F.lit("1"))
    rest = F.when(v.startswith("+"), F.substring(digits, F.length(code) + 1, F.length(digits))).otherwise(digits)
    return (
        F.when(F.col(kind) == "email", F.lower(v))
        .when(F.col(kind).isin("card", "ssn"), digits)
        .when(F.col(kind) == "iban", F.regexp_replace(v, " ", ""))
        .when(F.col(kind) == "phone", F.concat(code, F.lit("_"), rest))
        .otherwise(v)
    )


def _formatted(value: str, surrogate: str, kind: str) -> str:
    """SQL: the surrogate in the spelling of one occurrence; what exceeds its places is appended."""
    shown = f"case when {kind} = 'phone' and not startswith({value}, '+') then substring_index({surrogate}, '_', -1) else {surrogate} end"
    sure = f"regexp_replace({shown}, '[^0-9A-Za-z]', '')"
    alnum = "'[0-9A-Za-z]'"
    nth = f"length(regexp_replace(substring({value}, 1, i + 1), '[^0-9A-Za-z]', ''))"
    spread = f"concat(array_join(transform(filter(split({value}, ''), y -> y <> ''), (x, i) -> case when x rlike {alnum} then substring({sure}, {nth}, 1) else x end), ''), substring({sure}, 1 + length(regexp_replace({value}, '[^0-9A-Za-z]', '')), 99))"
    upper = f"{value} = upper({value}) and {value} <> lower({value})"
    return f"case when {kind} in ('card', 'ssn', 'phone', 'iban') then {spread} when {kind} = 'email' and {upper} then upper({surrogate}) else {surrogate} end"


def _typed(value: str) -> Column:
    out = None
    for kind, pattern in TYPES.items():
        hit = F.col(value).rlike(f"^(?:{pattern})$")
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("name")


def surrogates(docs: DataFrame, key: str) -> DataFrame:
    """docs with text (and n_chars, if it is there) rewritten, and n_entities, the number of entities replaced.

    docs needs doc_id and text; all other columns stay as they are, except one named n_entities. Texts
    without an entity, null and empty ones stay untouched. A document's entities are replaced from left to
    right; adjacent rows or repeated documents with equal texts get equal results under one key. Values
    that differ keep different surrogates, whatever document they stand in. An empty table gives none.
    """
    columns = [c for c in docs.columns if c != "n_entities"]
    docs = docs.select(*columns)
    hit = F.coalesce(F.col("text").rlike(HINT), F.lit(False)) & F.coalesce(F.regexp_instr("text", F.lit(MASTER)) > 0, F.lit(False))
    clean = docs.where(~hit).withColumn("n_entities", F.lit(0).cast("long"))
    found = docs.where(hit).withColumn(_P + "found", F.regexp_extract_all("text", F.lit(MASTER), F.lit(0)))
    found = _spark.materialize(found.withColumn(_P + "row", F.monotonically_increasing_id()), "entities")

    each = found.select(F.col(_P + "row").alias("row"), F.posexplode(_P + "found").alias("place", "value"))
    each = each.withColumn("kind", _typed("value"))
    # a name's words are entities of their own: the last is the family name, the title tells the gender
    words = F.when(F.col("kind") == "name", F.split(F.regexp_replace("value", "^\\S+ ", ""), "[ -]")).otherwise(F.array("value"))
    title = F.regexp_replace(F.regexp_extract("value", "^(\\S+) ", 1), "\\.$", "")
    gender = F.lit("u")
    for g in "fm":
        gender = F.when(title.isin(TITLES[g].split("|")), g).otherwise(gender)
    each = each.select("row", "place", "kind", "value", gender.alias("gender"), F.size(words).alias("size"), F.posexplode(words).alias("nth", "word"))
    script = F.when(F.col("word").rlike("\\p{IsCyrillic}"), "cyrillic").otherwise("latin")
    name = F.when(F.col("nth") == F.col("size") - 1, F.concat(F.lit("surname_"), script)).otherwise(F.concat(F.lit("given_"), script))
    each = each.withColumn("type", F.when(F.col("kind") == "name", name).otherwise(F.col("kind")))
    each = _spark.materialize(each.withColumn("norm", _normal("kind", "word")), "occurrences")

    told = [F.count_if(F.col("gender") == g).alias(g) for g in "mf"]
    values = each.groupBy("type", "norm").agg(F.count("*").alias("n"), *told)
    values = values.withColumn("gender", F.when(F.col("m") + F.col("f") == 0, "u").when(F.col("m") >= F.col("f"), "m").otherwise("f"))
    values = _spark.materialize(values, "values")
    table = _spark.materialize(assign(values, key), "surrogates")
    # a hot value would bring all its rows into one task: those few go to every task, the rest are shuffled
    least = max(HOT, (values.agg(F.sum("n")).first()[0] or 0) // SHARE)
    hot = _spark.materialize(values.where(F.col("n") >= least).select("type", "norm").join(table, ["type", "norm"]), "hot")
    hot = hot.withColumnRenamed("surrogate", "hot")
    each = each.join(F.broadcast(hot), ["type", "norm"], "left")  # at most SHARE rows
    columns_of = ["row", "place", "kind", "value", "nth", "word"]
    frequent = each.where("hot is not null").select(*columns_of, F.col("hot").alias("surrogate"))
    each = frequent.unionByName(each.where("hot is null").join(table, ["type", "norm"]).select(*columns_of, "surrogate"))
    each = each.select("row", "place", "kind", "value", "nth", F.expr(_formatted("word", "surrogate", "kind")).alias("new"))
    # back to entities: a name keeps its title and its separators
    parts = F.array_sort(F.collect_list(F.struct("nth", "new")))
    each = each.groupBy("row", "place").agg(F.first("kind").alias("kind"), F.first("value").alias("value"), parts.alias("parts"))
    joined = "concat(regexp_extract(value, '^(\\\\S+ )', 1), array_join(transform(parts, (x, i) -> concat(x.new, coalesce(get(filter(split(regexp_replace(regexp_replace(value, '^\\\\S+ ', ''), '[^ -]', ''), ''), y -> y <> ''), i), ''))), ''))"
    each = each.withColumn("new", F.when(F.col("kind") == "name", F.expr(joined)).otherwise(F.expr("parts[0].new")))
    per_row = each.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "new"))), lambda x: x["new"]).alias(_P + "new"))

    out = found.join(per_row.withColumnRenamed("row", _P + "row"), _P + "row")
    between = F.split("text", MASTER, -1)
    rewritten = F.array_join(F.zip_with(between, F.col(_P + "new"), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    out = out.withColumn(_P + "text", rewritten).withColumn("n_entities", F.size(_P + "found").cast("long"))
    new = {"text": F.col(_P + "text")} | ({"n_chars": F.length(_P + "text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in columns else {})
    out = out.withColumns(new).select(*columns, "n_entities")
    return clean.select(*columns, "n_entities").unionByName(out)
