"""Surrogates for personal data and secrets, with DataFrame and SQL functions only.

Entities (e-mail addresses, phone numbers, payment cards, social security
numbers, bank accounts, IPv4 and IPv6 addresses, access keys by their prefix, private key blocks, passwords and tokens that
are assigned or stated, and names after a title or an introduction) are found by one regular expression; the
words of such a name are replaced in the rest of the document too, where they begin with a capital.
Each gets a replacement that is drawn by a keyed hash of its normal form, so a
mention in any spelling and document gets the same one (coreference), and that
keeps type, format (digits, letters, case, separators, length), script (Latin or
Cyrillic) and, for names, the gender of the title.

Replacements are checked over the whole corpus: one that equals a real entity or
the replacement of another is drawn again with the next round's hash, until all
are distinct.  From the third round on they grow, so the rounds end.

Documents with equal lists of entities share one list of replacements; documents
without entities are passed through.  Runs of digit groups are cut into cards,
phone and social security numbers and the rest; numbers that only look like cards
(the check digit is wrong) stay.

Defined cases: a null text stays null; an empty text and texts without entities
stay as they are; repeated rows are treated alike and all kept; an empty table
gives an empty result; other columns are kept, and ``n_entities`` replaces a
column of that name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import drop_scratch, materialize

P = "__pii_"

MALE = "Mr|Herr|Monsieur|Señor|Sr|Don|Господин|Г-н"
FEMALE = "Mrs|Ms|Miss|Frau|Madame|Mme|Mademoiselle|Señora|Sra|Doña|Госпожа|Г-жа"
NEUTRAL = "Dr|Prof"
INTRODUCED = "(?i:my name is|mein name ist|ich heiße|je m['’]appelle|me llamo|mi nombre es|меня зовут)"
_TITLES = "|".join([MALE, FEMALE, NEUTRAL, *(t.upper() for t in (MALE, FEMALE, NEUTRAL)), r"mrs?(?=\.)", r"dr(?=\.)", r"prof(?=\.)"])
_NAME_WORD = r"\p{Lu}(?:['’]\p{Lu})?\p{L}+(?:-\p{Lu}\p{L}+)*"
_PASSWORD = "password|passwd|pwd|passphrase|passwort|kennwort|contraseña|clave|senha|mot de passe"
_TOKEN = "secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth[_-]?key"
_IS = r"(?i:is|was|ist|lautet|es|est)"
_ASSIGNED = r"\s{0,2}[=:]\s{0,2}"
_UNQUOTED_END = r"[^\s\"'.,;:!?)\]}>]"  # punctuation after a value is not of it
#: A value goes to the closing quote or to white space; a row of stars, dots or the like is no value.  After "is", a value has a digit or a sign.
SECRET = (
    rf"(?:(?i:{_PASSWORD})(?:[_-]\p{{L}}{{1,20}}){{0,2}}" + _ASSIGNED + r"(?![\"']?(?:\*+|\.+|x+|X+|•+|-+|_+|#+)[\"']?(?!\S))"
    r"(?:\"[^\"\r\n]{4,200}(?=\")|'[^'\r\n]{4,200}(?=')|[\"'][^\s\"']{4,}|[^\s\"']\S{2,}" + _UNQUOTED_END + r")"
    rf"|(?<!\p{{L}})(?i:{_PASSWORD})\s{{1,2}}{_IS}\s{{1,2}}[\"']?(?=\S*[\d!@#$%^&*])[^\s\"']\S{{2,}}" + _UNQUOTED_END +
    rf"|(?i:{_TOKEN})(?:[_-]\p{{L}}{{1,20}}){{0,3}}" + _ASSIGNED + r"(?:[\"'][^\s\"']{8,}|[^\s\"']\S{6,}" + _UNQUOTED_END + r")"
    r"|(?<!\p{L})(?i:bearer)\s{1,2}(?=\S*\d)[A-Za-z0-9._~+/-]{12,}={0,2}"
    r"|-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[^-]*+(?:-(?!----)[^-]*+){0,20}(?=-----END))")
_SECRET_HEAD = (rf"^(-----BEGIN [A-Z ]*PRIVATE KEY-----\s*|(?i:bearer)\s+|(?i:{_PASSWORD})\s+{_IS}\s+[\"']?|[^=:]*[=:]\s*[\"']?)")
#: Access keys by their prefix, which stays.
_KEY_HEAD = r"(?:(?:sk|pk|rk)[_-](?:[A-Za-z0-9]+[_-]){0,3}|gh[pousr]_|github_pat_|glpat-|xox[abeoprs]-|AIza|ya29\.|hf_|npm_)"
KEYS = rf"(?<![\p{{L}}\p{{N}}_-])(?=\S*\d){_KEY_HEAD}[A-Za-z0-9_-]{{0,200}}[A-Za-z0-9]{{16,}}(?![\p{{L}}\p{{N}}])"
_PHONE_WORD = r"(?<!\p{L})(?i:phone|tel|telephone|telefon|teléfono|téléphone|mobile|cell|móvil|handy|fax|call)(?i: ?(?:no|number|nummer))?[.:=]{0,2}\s{1,2}"
#: Digit groups one blank or hyphen apart, 13 digits or more: may hold cards, phone numbers and social security numbers (``_segments``).
RUN = r"(?<![\p{L}\d]|\d[.-])(?=\+?\d(?:[ -]?\+?\d){12})\+?\d++(?!\p{L}|\.\d)(?:[ -]\+?\d++(?!\p{L}|\.\d))*+"
PATTERN = "|".join([
    r"(?<![\p{L}\p{N}._%+-])[._%+-]*+[\p{L}\p{N}][\p{L}\p{N}._%+-]*+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+(?<!-)",
    SECRET,
    r"(?<![A-Z0-9])AKIA[0-9A-Z]{16}(?![A-Z0-9])",
    KEYS,
    r"(?<![\p{L}\d:.])(?:(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}|(?=[a-fA-F:]{0,39}\d)(?:[0-9a-fA-F]{1,4}:){1,6}(?::[0-9a-fA-F]{1,4}){1,6})(?![\p{L}\d:])",
    r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\d|\.\d)",
    r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    r"(?<![\p{L}\d]|\d[ .,-])(?!000|666|9)\d{3} \d{2} \d{4}(?![\p{L}\d]|[ .,-]\d)",
    _PHONE_WORD + r"\d{7,12}(?![\p{L}\d]|[.,-]\d)",
    RUN,
    r"(?<![\p{L}\d])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)",
    r"\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)",
    r"(?<![\p{L}\d]|\d[ .,/-])0\d{1,4}[ /-]\d{5,8}(?![\p{L}\d]|[ .,/-]\d)",
    r"(?<![A-Z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Z0-9])",
    rf"(?<!\p{{L}})(?:(?:{_TITLES})\.?|{INTRODUCED}) {_NAME_WORD}(?: {_NAME_WORD}){{0,2}}",
])
#: What any entity has: an at sign, a digit, a title or an introduction; an assignment has its sign.
HINT = rf"[@0-9=:]|(?<!\p{{L}})(?:(?:{_TITLES})\.?|{INTRODUCED}) \p{{Lu}}"

_DIGITS = r"regexp_replace({v}, '[^0-9]', '')"
_LUHN = (r"aggregate(transform(sequence(1, length({d})), i -> cast(substr({d}, length({d}) + 1 - i, 1) as int) * (1 + (i + 1) % 2)), 0L, "
         r"(a, x) -> a + x div 10 + x % 10) % 10")
_CYRILLIC_LOW, _CYRILLIC_UP = "абвгдежзиклмнопрстуфхцчшэюя", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ"


def _drawn(stream: str, i: str, n) -> str:
    """SQL: number number ``i`` below ``n`` from a stream of hexadecimal digits."""
    return f"(cast(conv(substr({stream}, 1 + (3 * ({i})) % 120, 4), 16, 10) as int) % ({n}))"


def _pick(letters: str, stream: str, i: str) -> str:
    return f"substr('{letters}', 1 + {_drawn(stream, i, len(letters))}, 1)"


def _like(v: str, stream: str) -> str:
    """SQL: ``v`` with each letter and digit replaced by one of its kind."""
    c = f"substr({v}, i, 1)"
    return (f"array_join(transform(sequence(1, length({v})), i -> case "
            f"when {c} rlike '[0-9]' then {_pick('0123456789', stream, 'i')} "
            f"when {c} rlike '[a-z]' then {_pick('abcdefghijklmnopqrstuvwxyz', stream, 'i')} "
            f"when {c} rlike '[A-Z]' then {_pick('ABCDEFGHIJKLMNOPQRSTUVWXYZ', stream, 'i')} "
            f"when {c} rlike '[а-яё]' then {_pick(_CYRILLIC_LOW, stream, 'i')} "
            f"when {c} rlike '[А-ЯЁ]' then {_pick(_CYRILLIC_UP, stream, 'i')} "
            f"when {c} rlike '[\\\\p{{Ll}}]' then {_pick('áàâäéèêëíîïóôöúûüñç', stream, 'i')} "
            f"when {c} rlike '[\\\\p{{L}}]' then {_pick('ÁÀÂÄÉÈÊËÍÎÏÓÔÖÚÛÜÑÇ', stream, 'i')} "
            f"else {c} end), '')")


def _hex_like(v: str, stream: str) -> str:
    return f"array_join(transform(sequence(1, length({v})), i -> {_pick('0123456789abcdef', stream, 'i')}), '')"


def _hex_digits(v: str, stream: str) -> str:
    c = f"substr({v}, i, 1)"
    return f"array_join(transform(sequence(1, length({v})), i -> if({c} rlike '[0-9a-f]', {_pick('123456789abcdef', stream, 'i')}, {c})), '')"


def _name(stream: str, ending: str) -> str:
    """SQL: a name of two to three drawn syllables, Cyrillic if the norm is, with an ending for the gender."""
    latin = "element_at(array('ba','ce','da','el','fi','ga','he','in','jo','ka','le','mi','no','or','pe','ra','sa','ti','ul','ve'), 1 + {})"
    cyr = "element_at(array('ба','ве','га','де','жи','за','ка','ли','ма','не','ор','па','ра','си','та','ул','фе','ха','ци','ша'), 1 + {})"
    part = lambda t: f"concat({t.format(_drawn(stream, '1', 20))}, {t.format(_drawn(stream, '2', 20))}, {t.format(_drawn(stream, '3', 20))})"
    return f"case when norm rlike '[а-яё]' then {part(cyr)} else concat({part(latin)}, '{ending}') end"


def mentions(text):
    """The matched strings of a text in order; the empty list for most texts after a quick look."""
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _typed(value: str) -> str:
    d = _DIGITS.format(v=value)
    quoted = lambda x: x.replace("\\", "\\\\").replace("'", "\\'")
    return (f"case when {value} rlike '^[^ =:]+@' then 'email' "
            f"when {value} rlike '{quoted(f'^(?i:{_PASSWORD}|{_TOKEN}|bearer |-----BEGIN )')}' then 'secret' "
            f"when {value} rlike '{quoted(f'^(?:AKIA[0-9A-Z]{{16}}$|{_KEY_HEAD})')}' then 'key' "
            f"when {value} rlike '^[0-9a-fA-F:]*:[0-9a-fA-F]*:[0-9a-fA-F:]*$' then 'ip6' "
            f"when {value} rlike '{quoted(f'^(?:(?:{_TITLES})[.]?|{INTRODUCED}) ')}' then 'name' "
            f"when {value} rlike '^[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+$' then 'ip' "
            f"when {value} rlike '^[0-9]{{3}}([ -])[0-9]{{2}}[ -][0-9]{{4}}$' then 'ssn' "
            f"when {value} rlike '^[A-Z]{{2}}[0-9]{{2}}' then 'iban' "
            f"when {value} rlike '^0[0-9]{{1,4}}[ /-][0-9]{{5,8}}$' then 'phone' "
            f"when {value} rlike '^[+]?[0-9][0-9 +-]*$' then 'run' "
            f"else 'phone' end")


def _segments(groups: str) -> str:
    """SQL: ``array<struct<kind, value>>`` of a run from its groups (each with the separator before it).

    From left to right, each group begins the first of these that fits, or is passed over: a number with a plus sign, a
    social security number, a phone number of 3-3-4 digits, a card.  A card is one group or groups of four and more
    digits (the last of three and more) with 13 to 19 digits, a right check digit and, unless it is one group or the
    whole run, an issuer's first digits; every start and number of groups is tried.
    """
    text = lambda i, n: f"regexp_replace(array_join(slice({groups}, {i}, {n}), ''), '^[ -]', '')"
    digits = lambda i, n: f"regexp_replace(array_join(slice({groups}, {i}, {n}), ''), '[^0-9]', '')"
    fits = lambda i, n: f"{i} + {n} - 1 <= size({groups})"
    card = lambda i: (
        f"get(filter(array(4, 3, 1, 5, 2), c -> {fits(i, 'c')} and length({digits(i, 'c')}) between 13 and 19 and ("
        f"{text(i, 'c')} rlike '^[0-9]+$|^(?:[3-6][0-9]|2[2-7])[0-9]{{2,}}(?:[ -][0-9]{{4,}})*[ -][0-9]{{3,}}$' "
        f"or c = size({groups}) and {text(i, 'c')} rlike '^[0-9]{{4,}}(?:[ -][0-9]{{4,}})*[ -][0-9]+$') "
        f"and {_LUHN.format(d=digits(i, 'c'))} = 0), 0)")
    abroad = (
        f"array_max(transform(filter(sequence(1, 6), n -> {fits('at', 'n')} and {text('at', 'n')} rlike '^[+][0-9]+(?:[ -][0-9]{{2,}})*$' "
        f"and length({digits('at', 'n')}) between 5 and if(n = 1, 23, 15)), n -> struct("
        f"{text('at', 'n')} rlike '^[+][0-9]{{1,3}}(?:[ -][0-9]{{3}}){{2}}[ -][0-9]{{4}}$' or {card('(at + n)')} is not null as whole, n as n))).n")
    found = (
        f"case when {text('at', 1)} like '+%' then named_struct('kind', 'phone', 'n', {abroad}) "
        f"when {text('at', 3)} rlike '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$' and element_at({groups}, at) not like '-%' "
        f"and coalesce(get({groups}, at + 2), '') not like '-%' then named_struct('kind', 'ssn', 'n', 3) "
        f"when {text('at', 3)} rlike '^[0-9]{{3}}[ -][0-9]{{3}}[ -][0-9]{{4}}$' then named_struct('kind', 'phone', 'n', 3) "
        f"else named_struct('kind', 'card', 'n', {card('at')}) end")
    passed = "named_struct('kind', 'none', 'n', 1)"
    value = f"array_join(slice({groups}, at, f.n), '')"
    step = (
        f"if(at < a.next, a, element_at(transform(transform(array({found}), x -> if(x.n is null, {passed}, x)), f -> named_struct("
        f"'next', at + f.n, 'out', concat(a.out, array(named_struct('kind', f.kind, 'value', {value}))))), 1))")
    return (f"aggregate(sequence(1, size({groups})), named_struct('next', 1, 'out', cast(array() as array<struct<kind: string, value: string>>)), "
            f"(a, at) -> {step}).out")


def _parts(lists: DataFrame) -> DataFrame:
    """``key, pos, segment, part, prefix, type, value, norm``: a row for each mention, segment of a run, or word of a name."""
    m = lists.select("key", F.posexplode("ents").alias("pos", "mention")).withColumn("kind", F.expr(_typed("mention")))
    m = m.withColumn("groups", F.when(F.col("kind") == "run", F.split("mention", "(?=[ -])")))
    one = "array(named_struct('kind', if(kind = 'run', 'none', kind), 'value', mention))"
    m = m.withColumn("held", F.expr(f"if(kind = 'run', {_segments('groups')}, null)"))
    m = m.withColumn("held", F.expr(f"if(exists(held, x -> x.kind <> 'none'), held, {one})"))
    m = m.select("key", "pos", F.posexplode("held").alias("segment", "x")).select(
        "key", "pos", "segment", F.col("x.kind").alias("kind"), F.col("x.value").alias("mention"))
    head = (F.when(F.col("kind") == "secret", F.regexp_extract("mention", _SECRET_HEAD, 1))
            .when(F.col("kind") == "key", F.regexp_extract("mention", f"^({_KEY_HEAD})", 1))
            .when(F.col("kind") == "phone", F.regexp_extract("mention", r"^(\p{L}[^\d+(]*)", 1))
            .when(F.col("kind") == "email", F.regexp_extract("mention", r"^([._%+-]*)", 1))
            .when(F.col("kind") == "name", F.regexp_extract("mention", rf"^({INTRODUCED} |\S+ )", 1)).otherwise(""))
    m = m.withColumn("head", head).withColumn("rest", F.expr("substr(mention, length(head) + 1)"))
    # The words of a name, each with the blank, hyphen or "O'" before it.
    words = F.when(F.col("kind") == "name", F.split("rest", r"(?=[ -]\p{L})")).otherwise(F.array("rest"))
    m = m.withColumn("words", words).select(
        "key", "pos", "segment", "kind", "head", F.size("words").alias("n"), F.posexplode("words").alias("part", "word"))
    lead = F.when(F.col("kind") == "name", F.regexp_extract("word", r"^([ -]?(?:\p{L}['’])?)", 1)).otherwise("")
    m = m.withColumn("lead", lead).withColumn("value", F.expr("substr(word, length(lead) + 1)"))
    prefix = F.concat(F.when(F.col("part") == 0, F.col("head")).otherwise(""), "lead")
    gender = F.when(F.col("head").rlike(f"^(?i:{FEMALE})[. ]"), "f").when(F.col("head").rlike(f"^(?i:{MALE})[. ]"), "m").otherwise("n")
    last = F.col("part") >= F.col("n") - F.when(F.col("word").startswith("-") | F.lead("word").over(
        Window.partitionBy("key", "pos", "segment").orderBy("part")).startswith("-"), 2).otherwise(1)
    kind = F.when(F.col("kind") != "name", F.col("kind")).when(last, F.lit("surname")).otherwise(F.concat(F.lit("given_"), gender))
    m = m.select("key", "pos", "segment", "part", prefix.alias("prefix"), kind.alias("type"), "value")
    norm = (F.when(F.col("type").isin("email", "ip6"), F.lower("value"))
            .when(F.col("type").isin("card", "ssn"), F.expr(_DIGITS.format(v="value")))
            .when(F.col("type") == "phone", F.expr(f"right({_DIGITS.format(v='value')}, 10)"))
            .when(F.col("type") == "iban", F.regexp_replace("value", " ", ""))
            .when(F.col("type") == "surname", F.regexp_replace(F.lower("value"), "(?<=[вн])а$", ""))
            .when(F.col("type").startswith("given"), F.lower("value"))
            .otherwise(F.col("value")))
    return m.withColumn("norm", norm)


def _surrogate(key: str, turn: int):
    """The replacement of the normal form in round ``turn``, as a column over ``type, norm``."""
    secret = key.replace("\\", "\\\\").replace("'", "\\'")
    seed = f"concat('{secret}|{turn}|', type, '|', norm)"
    s = f"concat(sha2({seed}, 256), sha2(concat({seed}, '+'), 256))"
    domain = f"concat('{secret}|domain|', substring_index(norm, '@', -1))"
    ds = f"concat(sha2({domain}, 256), sha2(concat({domain}, '+'), 256))"
    local, host = "substring_index(norm, '@', 1)", "regexp_extract(norm, '@(.*)[.][^.]*$', 1)"
    more = f"substr({s}, 1, {max(0, turn - 2)})"  # longer replacements when short ones ran out
    more_digits = f"translate({more}, 'abcdef', '012345')"
    body = f"concat(substr(norm, 1, 1), substr({_like('norm', s)}, 2, length(norm) - 2))"
    wanted = f"(10 - ({_LUHN.format(d='concat(x, chr(48))')})) % 10"
    octet = lambda i, low, n: f"cast({low} + {_drawn(s, str(i), n)} as string)"
    return F.expr(
        f"case when type = 'email' then concat({_like(local, s)}, {more}, '@', {_like(host, ds)}, '.', substring_index(norm, '.', -1)) "
        f"when type in ('secret', 'key') then concat(case when norm rlike '^AKIA' then 'AKIA' else '' end, case when norm rlike '^[0-9a-f]+$' "
        f"then {_hex_like('norm', s)} when norm rlike '^AKIA' then {_like('substr(norm, 5)', s)} else {_like('norm', s)} end, {more}) "
        f"when type = 'ip6' then {_hex_digits('norm', s)} "
        f"when type = 'ip' then concat_ws('.', {octet(1, 1, 223)}, {octet(2, 0, 256)}, {octet(3, 0, 256)}, {octet(4, 1, 254)}) "
        f"when type = 'card' then element_at(transform(array({body}), x -> concat(x, cast({wanted} as string))), 1) "
        f"when type = 'ssn' then concat('9', substr({_like('norm', s)}, 2), {more_digits}) "
        f"when type = 'phone' then concat(cast(2 + {_drawn(s, '40', 8)} as string), substr({_like('norm', s)}, 2), {more_digits}) "
        f"when type = 'iban' then concat(substr(norm, 1, 2), {_like('substr(norm, 3)', s)}) "
        f"when type = 'given_f' then concat({_name(s, 'na')}, {more_digits}) "
        f"when type = 'given_m' then concat({_name(s, 'no')}, {more_digits}) "
        f"when type = 'given_n' then concat({_name(s, 'ne')}, {more_digits}) "
        f"when type = 'surname' then concat({_name(s, 'son')}, case when norm rlike '[а-яё]' then 'ов' else '' end, {more_digits}) "
        f"else norm end")


def assign_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """``type, norm, surrogate`` for distinct ``type, norm``: distinct within a type, and none equal to a real entity."""
    pending, settled, turn = entities, None, 0
    while True:
        drawn = pending.withColumn("surrogate", _surrogate(key, turn))
        real = entities.select("type", F.col("norm").alias("surrogate"), F.lit(True).alias("real"))
        drawn = drawn.join(real, ["type", "surrogate"], "left")
        if settled is not None:
            drawn = drawn.join(settled.select("type", "surrogate", F.lit(True).alias("taken")), ["type", "surrogate"], "left")
        else:
            drawn = drawn.withColumn("taken", F.lit(None).cast("boolean"))
        first = drawn.groupBy("type", "surrogate").agg(F.min("norm").alias("winner"))
        drawn = drawn.join(first, ["type", "surrogate"])
        good = F.col("real").isNull() & F.col("taken").isNull() & (F.col("winner") == F.col("norm"))
        drawn = materialize(drawn.select("type", "norm", "surrogate", good.alias("good")), "pii-round")
        won = drawn.where("good").drop("good")
        settled = won if settled is None else settled.unionByName(won)
        pending = drawn.where("not good").select("type", "norm")
        if pending.isEmpty():
            return settled
        turn += 1


def _rendered():
    """The replacement in the format of the mention: columns ``type, value, surrogate``."""
    keep = "greatest(0, length(regexp_replace(value, '[^0-9]', '')) - length(surrogate))"
    digit = "length(regexp_replace(substr(value, 1, i), '[^0-9]', ''))"
    poured = (f"concat(array_join(transform(sequence(1, length(value)), i -> case when substr(value, i, 1) rlike '[0-9]' and {digit} > {keep} "
              f"then substr(surrogate, {digit} - {keep}, 1) else substr(value, i, 1) end), ''), "
              f"substr(surrogate, 1 + length(regexp_replace(value, '[^0-9]', '')) - {keep}))")
    nth = "length(regexp_replace(substr(value, 1, i), ' ', ''))"
    spaced = f"array_join(transform(sequence(1, length(value)), i -> case when substr(value, i, 1) = ' ' then ' ' else substr(surrogate, {nth}, 1) end), '')"
    female = "case when value rlike '(?<=[вн])а$' then 'а' else '' end"
    cased = "case when value = upper(value) then upper(concat(surrogate, {e})) else concat(upper(substr(surrogate, 1, 1)), substr(surrogate, 2), {e}) end"
    return F.expr(
        f"case when type = 'none' then value when type in ('phone', 'card', 'ssn') then {poured} when type = 'iban' then {spaced} "
        f"when type = 'email' then case when value = upper(value) then upper(surrogate) else surrogate end "
        f"when type = 'surname' then {cased.format(e=female)} when type like 'given%' then {cased.format(e=repr(''))} else surrogate end")


def replace_pii(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with surrogates in ``text``, and ``n_entities``, the number of replaced mentions."""
    columns = [c for c in docs.columns if c == text or c != "n_entities"]
    # Written with the lists of mentions, so that the expression runs once over each text.
    base = materialize(docs.select(*columns).withColumn(P + "ents", mentions(F.col(text))), "pii-mentions")
    some = F.coalesce(F.size(P + "ents") > 0, F.lit(False))
    found = base.where(some).withColumn(P + "key", F.md5(F.concat_ws("\x01", P + "ents").cast("binary")))
    lists = materialize(found.groupBy(F.col(P + "key").alias("key")).agg(F.first(P + "ents").alias("ents")), "pii-lists")
    parts = materialize(_parts(lists), "pii-parts")
    entities = materialize(parts.where("type <> 'none'").select("type", "norm").distinct(), "pii-entities")
    settled = assign_surrogates(entities, key)
    shown = parts.join(settled, ["type", "norm"], "left").withColumn("bare", _rendered()).withColumn("shown", F.concat("prefix", "bare"))
    word = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("segment", "part", "shown"))), lambda x: x["shown"]), "")
    whole = shown.groupBy("key", "pos").agg(word.alias("shown"), F.sum(((F.col("type") != "none") & (F.col("part") == 0)).cast("int")).alias("real"))
    ready = whole.groupBy(F.col("key").alias(P + "key")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "shown"))), lambda x: x["shown"]).alias(P + "new"),
        F.sum("real").cast("int").alias(P + "n"))
    first = shown.where("type = 'surname' or type like 'given%'").groupBy("key", F.lower("value").alias("value")).agg(F.min(F.struct("pos", "bare")).alias("first"))
    names = first.groupBy(F.col("key").alias(P + "key")).agg(F.map_from_entries(F.collect_list(F.struct("value", "first"))).alias(P + "names"))
    ready = materialize(ready.join(names, P + "key", "left"), "pii-ready")
    pieces = F.split(F.col(text), PATTERN, -1)
    changed = found.join(ready, P + "key").withColumn(P + "pieces", pieces)
    # Words of a name that was found before, in the text after it: ``to`` is null for other words.
    bare = f"{P}names[lower(w)].bare"
    cased = f"if(w = upper(w) and length(w) > 1, upper({bare}), concat(upper(substr({bare}, 1, 1)), lower(substr({bare}, 2))))"
    later = (f"transform({P}pieces, (piece, i) -> if({P}names is null, null, transform(regexp_extract_all(piece, '[\\\\p{{L}}\\\\p{{M}}]+|[^\\\\p{{L}}\\\\p{{M}}]+', 0), "
             f"w -> struct(w as word, if({P}names[lower(w)].pos < i and w rlike '^\\\\p{{Lu}}', {cased}, null) as to))))")
    changed = changed.withColumn(P + "later", F.expr(later))
    piece = f"if({P}names is null, get({P}pieces, i), array_join(transform(get({P}later, i), x -> coalesce(x.to, x.word)), ''))"
    rebuilt = F.expr(f"array_join(transform(sequence(0, size({P}pieces) - 1), i -> concat({piece}, coalesce(get({P}new, i), ''))), '')")
    again = F.expr(f"if({P}names is null, 0, aggregate({P}later, 0, (n, x) -> n + size(filter(x, y -> y.to is not null))))")
    changed = changed.withColumn(text, rebuilt).withColumn("n_entities", F.col(P + "n") + again)
    calm = base.where(~some).withColumn("n_entities", F.lit(0))
    return drop_scratch(changed, P).select(*columns, "n_entities").unionByName(calm.select(*columns, "n_entities"))


def session_key(spark) -> str:
    """The key of the corpus: the session's ``spark.tessera.pii.key``, else a fixed one, which protects nobody."""
    return spark.conf.get("spark.tessera.pii.key", None) or "corpus-key-1"


def op3_pii_surrogates(docs: DataFrame) -> DataFrame:
    done = replace_pii(docs.select("doc_id", "text"), session_key(docs.sparkSession))
    return done.select("doc_id", "text", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), "n_entities")
