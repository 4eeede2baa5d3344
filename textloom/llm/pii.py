"""Surrogates for personal data, with DataFrame functions only.

Detection is one regular expression over the whole text. Each distinct entity is reduced to components (the digits of a
phone number or card, an address in lower case, a given name, a surname), and each distinct component gets a keyed
replacement: SHA-512 of key, kind, component and attempt drives a choice of characters of the same class and script, of
names of the same gender and script, or of a card or account number that passes the same check as the original. A given
name is one component whatever title stands before it; its gender is the one that most of its titles tell. Rounds of
collision checks give another attempt to replacements that two components share, that were given before, or that occur
as real components, until all differ. Mentions of one component in several formats get the same replacement in each
mention's own format (separators, case, title), in all documents. Names are found behind titles and phrases such as "my
name is", and before Chinese and Japanese titles; the full names, surnames and given names found so are then replaced
wherever the same text mentions them as whole words, as written or in capitals. A run of 13 to 19 digits is a card number
if it passes the Luhn check or if a word such as "card" stands before it on its line; other runs are plain numbers.

Defined cases: a null text stays null, an empty one empty, a text without an entity is returned as it came. Rows keep
their number; rows of equal text get equal results; extra columns stay where ``replace`` is used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm._common import small
from textloom.session import materialise

_B, _E = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
#: Titles by gender; a fixed list of words.
FEMALE = "Mrs|Ms|Miss|Madam|Frau|Fräulein|Madame|Mme|Mlle|Señora|Señorita|Sra|Srta|госпожа|г-жа|κυρία|κα"
MALE = "Mr|Sir|Herr|Monsieur|Señor|Sr|господин|г-н|κύριος|κύριο|κ"
OTHER = "Dr|Prof|Professor|Doctor"
#: What people say before their names, and titles behind names; fixed lists of words.
CUES = "(?:[Mm]y name is|[Ii]ch heiße|[Mm]ein Name ist|[Jj]e m['’]appelle|[Mm]e llamo|[Mm]i nombre es|[Мм]еня зовут|[Μμ]ε λένε)"
HAN_TITLES = "先生|女士|小姐|太太|教授|博士|医生"
KANA_TITLES = "さん|様"
CARD_WORDS = "card|visa|mastercard|amex|karte|carte|tarjeta|карт"
GIVEN_FEMALE = ("Anna", "Clara", "Diana", "Elena", "Flora", "Helga", "Irene", "Julia", "Karin", "Laura", "Maria", "Nadia", "Olivia", "Paula", "Rosa", "Sonia")
GIVEN_MALE = ("Adrian", "Boris", "Carlos", "David", "Emil", "Felix", "Georg", "Hugo", "Igor", "Jonas", "Konrad", "Leon", "Martin", "Oscar", "Pablo", "Viktor")
GIVEN_OTHER = ("Alex", "Andrea", "Charlie", "Dominique", "Jules", "Kim", "Luca", "Morgan", "Nikita", "Noa", "Robin", "Sam", "Sasha", "Toni", "Valery", "Yuri")
CYRILLIC_FEMALE = ("Анна", "Вера", "Дарья", "Елена", "Зоя", "Ирина", "Лидия", "Мария", "Нина", "Ольга", "Раиса", "София", "Тамара", "Ульяна", "Юлия", "Яна")
CYRILLIC_MALE = ("Антон", "Борис", "Вадим", "Глеб", "Денис", "Егор", "Иван", "Кирилл", "Лев", "Марк", "Никита", "Олег", "Павел", "Роман", "Семён", "Юрий")
SYLLABLES = ("al", "ber", "cor", "dan", "el", "far", "gar", "hol", "in", "jor", "kel", "lan", "mor", "nor", "or", "pel", "quin", "ros", "sel", "tor", "ul", "van", "wel", "yor", "zan", "bri", "cla", "dro", "fen", "gil", "har", "lem")
GREEK_FEMALE = ("Άννα", "Βασιλική", "Γεωργία", "Ελένη", "Ειρήνη", "Ζωή", "Ιωάννα", "Κατερίνα", "Μαρία", "Σοφία", "Φωτεινή", "Χριστίνα")
GREEK_MALE = ("Ανδρέας", "Βασίλης", "Γιάννης", "Γιώργος", "Δημήτρης", "Κώστας", "Μιχάλης", "Νίκος", "Παύλος", "Πέτρος", "Σπύρος", "Χρήστος")
HAN_FEMALE = ("芳", "丽", "敏", "静", "娟", "艳", "霞", "秀", "兰", "玲", "娜", "婷")
HAN_MALE = ("伟", "强", "磊", "军", "勇", "杰", "涛", "超", "刚", "斌", "辉", "鹏")
HAN_FAMILY = tuple("王李张刘陈杨黄赵吴周徐孙马朱胡郭何林高罗郑梁谢宋唐许韩冯邓曹彭曾肖田董袁潘于蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦傅方白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵万钱严覃武戴莫孔向汤")
GREEK_SYLLABLES = ("κα", "λο", "μι", "νε", "πα", "ρο", "σα", "τη", "βα", "γε", "δι", "ζα", "θε", "φι", "χα", "ψι")
CYRILLIC_SYLLABLES = ("ба", "ви", "го", "де", "жа", "за", "ка", "ло", "ми", "но", "па", "ро", "са", "ту", "фе", "ша")

EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}_%+-][\p{L}\p{N}._%+-]{0,254}+@(?:[\p{L}\p{N}-]{1,63}\.){1,8}\p{L}{2,24}"
IBAN = _B + r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?" + _E
KEYED = _B + r"(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,80}|sk-[A-Za-z0-9_-]{20,100}|xox[abprs]-[A-Za-z0-9-]{10,100})" + _E
LABELLED = _B + r"(?i:password|passwd|pwd|api[_-]?key|secret|token)[\"']?[ \t]{0,3}[:=][ \t]{0,3}[\"']?[^\s\"'<>]{6,128}"
HEX = _B + r"(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})" + _E
IPV6 = r"(?<![\p{L}\p{N}:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\p{L}\p{N}:])"
MAC = r"(?<![\p{L}\p{N}:])(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}(?![\p{L}\p{N}:])"
IPV4 = r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)"
CARD = r"(?<!\d)\d{4}(?<sep>[ -]?)\d{4}\k<sep>\d{4}\k<sep>\d{1,7}(?!\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
PHONE = r"(?<![\p{L}\p{N}+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4}|0\d{2,4}[ .-]\d{3,4}[ .-]\d{3,4}|0\d{2,4}[ /-]\d{6,8}|0\d(?:[ .-]\d{2}){4})(?!\d)"
_CASED = r"\p{Lu}[\p{L}\p{M}'’-]{1,30}"
_UNCASED = r"[\p{IsHebrew}\p{IsArabic}\p{IsDevanagari}\p{IsThai}\p{IsHangul}\p{IsHiragana}\p{IsKatakana}\p{IsGeorgian}][\p{L}\p{M}]{1,20}"
_HAN = r"\p{IsHan}{2,4}"
_TITLED = rf"(?:(?:{FEMALE}|{MALE}|{OTHER})\.? |{CUES} )"
PERSON = _B + rf"{_TITLED}(?:{_CASED}(?: {_CASED})?|{_UNCASED}(?: {_UNCASED})?|{_HAN})"
HAN_PERSON = rf"[{''.join(HAN_FAMILY)}]\p{{IsHan}}{{1,2}}(?={HAN_TITLES})|\p{{IsHan}}{{2,3}}(?={KANA_TITLES})"
# At most places of a text no pattern can begin; looking at one character and the one before it tells that at small cost.
_T = f"(?=[{''.join(sorted({x[0] for x in '|'.join((FEMALE, MALE, OTHER)).split('|')}))}])"
_C = "(?=[mijMIJμΜмМ])"
_L = "(?=[pPaAsStT])"
_K = "(?=[Agsx])"
_WORDED = "|".join((EMAIL, IBAN, _K + KEYED, _L + LABELLED, HEX, IPV6, MAC, f"(?:{_T}|{_C}){PERSON}"))
_NUMBERED = "|".join((EMAIL, HEX, IPV6, MAC, IPV4, CARD, SSN, PHONE))
ANY = rf"(?=\p{{L}})(?:(?<![\p{{L}}\p{{N}}])(?:{_WORDED})|{_L}{LABELLED}|(?=[\u4E00-\u9FFF])(?:{HAN_PERSON}))|(?=[\p{{N}}(+_%-])(?<!\d)(?:{_NUMBERED})"
#: Whatever ANY matches holds a digit, an @ or one of these, and most texts don't.
MAYBE = rf"{_L}(?i:password|passwd|pwd|api[_-]?key|secret|token)|(?<![\p{{L}}\p{{N}}_]){_T}(?:{FEMALE}|{MALE}|{OTHER})\.? [\p{{Lu}}\p{{Lo}}]|(?=[a-fA-F])(?:[a-f]{{32}}|[A-F]{{32}}|[A-Fa-f]{{1,4}}(?:[:-][A-Fa-f]{{1,4}}){{5}})"
_PARTS = ("AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-", "xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-", "y name is", "ch heiße", "ein Name ist", "appelle", "e llamo", "i nombre es", "еня зовут", "ε λένε", *HAN_TITLES.split("|"), *KANA_TITLES.split("|"))
ATTEMPTS = 40
ROWS_A_TASK = 500


def entities(text: Column) -> Column:
    """The entities of a text, in order."""
    return F.when(reduce(lambda a, x: a | text.contains(x), _PARTS, text.rlike(r"[\d@]")) | text.rlike(MAYBE), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def plain_number(raw: Column) -> Column:
    """Is an entity a run of digits that only looks like a card number?"""
    return raw.rlike(f"^(?:{CARD})$") & (_luhn(_digits_of(raw)) != 0)


def told_cards(text: Column) -> Column:
    """The runs of digits before which a word on the same line says that they are card numbers."""
    return F.regexp_extract_all(text, F.lit(rf"(?<=(?i:{CARD_WORDS})[^\n]{{0,80}}){CARD}"), F.lit(0))


def _at(s: Column, i: Column) -> Column:
    return s.substr(i, F.lit(1))


def _byte(stream: Column, i: Column) -> Column:
    """The i-th (from 0) byte of a stream of 128 bytes in hex, as a number; it starts over at the end."""
    return F.conv(stream.substr(F.pmod(i, F.lit(128)).cast("int") * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _pick(choice: str, b: Column) -> Column:
    return F.lit(choice).substr(F.pmod(b, F.lit(len(choice))).cast("int") + 1, F.lit(1))


_SETS = (("[0-9]", "0123456789"), ("[a-z]", "abcdefghijklmnopqrstuvwxyz"), ("[A-Z]", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("[\\u00DF-\\u024F]", "àâäåæçèéêëíîïñóôöøúüý"), ("[а-яё]", "абвгдежзийклмнопрстуфхцчшщыэюя"), ("[А-ЯЁ]", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЫЭЮЯ"), ("[\\u0370-\\u03FF]", "αβγδεζηθικλμνξοπρστυφχψω"), ("[\\u4E00-\\u9FFF]", "安白陈丁方高何江李林马孟宁彭秦任宋田王徐杨赵周"), ("[\\u05D0-\\u05EA]", "אבגדהוזחטילמנסעפקרשת"), ("[\\u0620-\\u064A\\u0671-\\u06D3]", "ابتثجحدرزسشصطعفقكلمنهوي"), ("[\\u0904-\\u0939]", "कखगघचछजटडतदनपफबभमयरलवसह"), ("[\\u0E01-\\u0E2E]", "กขคงจชดตทนบปผพมยรลวสหอ"), ("[\\uAC00-\\uD7A3]", "강고김나남노도류마문민박배서석성손송신안양오유윤이장전정조주진최한허홍황"), ("[\\u3041-\\u3096]", "あいうえおかきくけこさしすせそたちつてとなにのはひふまみむやゆよらりるれろわ"), ("[\\u30A1-\\u30FA]", "アイウエオカキクケコサシスセソタチツテトナニノハヒフマミムヤユヨラリルレロワ"), ("[\\u0531-\\u0556]", "ԱԲԳԴԵԶԷԹԻԼԽԿՀՄՆՊՍՎՏՐ"), ("[\\u0561-\\u0586]", "աբգդեզէթիլխկհմնպսվտր"), ("[\\u10D0-\\u10F0]", "აბგდევზთიკლმნოპრსტუფ"))


def _scramble(s: Column, stream: Column, sets=_SETS) -> Column:
    """Each letter and digit becomes one of its class and script; only letters of scripts that no set names (neither Latin,
    Cyrillic, Greek, Han, Hebrew, Arabic, Devanagari, Thai, Hangul, kana, Armenian nor Georgian) become Latin ones. Marks
    stay."""

    def one(i: Column) -> Column:
        c, b = _at(s, i), _byte(stream, i - 1)
        out = F.when(c.rlike(r"\p{L}|\p{N}"), _pick(_SETS[1][1], b)).otherwise(c)
        for pattern, choice in reversed(sets):
            out = F.when(c.rlike(pattern), _pick(choice, b)).otherwise(out)
        return out

    return F.when(F.length(s) == 0, "").otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), one), ""))


_HEXES = (("[0-9a-f]", "0123456789abcdef"),)


def _digits_of(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Luhn sum of a string of digits, modulo 10."""
    n = F.length(digits)

    def one(i: Column) -> Column:
        d = _at(digits, i).cast("int")
        twice = F.pmod(n - i, F.lit(2)) == 1
        return F.when(twice, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)

    return F.pmod(F.aggregate(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), one), F.lit(0), lambda a, x: a + x), F.lit(10))


def _mod97(s: Column) -> Column:
    """An account number's letters and digits, read as a number (A is 10), modulo 97."""

    def step(a: Column, i: Column) -> Column:
        c = _at(s, i)
        v = F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return F.pmod(a * F.when(v > 9, 100).otherwise(10) + v, F.lit(97)).cast("int")

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), F.lit(0), step)


def _title(raw: Column) -> Column:
    return F.regexp_extract(raw, f"^{_TITLED}", 0)


def kind_of(raw: Column) -> Column:
    whole = lambda p: raw.rlike(f"^(?:{p})$")
    out = F.lit("key")
    for name, pattern in (("person", f"{PERSON}|{_HAN}"), ("phone", PHONE), ("ssn", SSN), ("card", CARD), ("ipv4", IPV4), ("mac", MAC), ("ipv6", IPV6), ("hex", HEX), ("labelled", LABELLED), ("key", KEYED), ("iban", IBAN), ("email", EMAIL)):
        out = F.when(whole(pattern), name).otherwise(out)
    return out


def components(kind: Column, raw: Column) -> Column:
    """(part, kind, component, gender told) of an entity; parts of equal kind and component are one thing in any format."""
    one = lambda k, v: F.struct(F.lit(1).alias("part"), k.alias("kind"), v.alias("norm"), F.lit("n").alias("gender"))
    digits = _digits_of(raw)
    phone = F.when(digits.rlike("^1[0-9]{10}$"), F.substring(digits, 2, 10)).otherwise(digits)
    title = _title(raw)
    name = raw.substr(F.length(title) + 1, F.length(raw))
    han = name.rlike(f"^{_HAN}$")
    names = F.when(han, F.array(name.substr(F.lit(2), F.length(name)), name.substr(F.lit(1), F.lit(1)))).otherwise(F.split(name, " "))
    gender = F.when(title.rlike(rf"^(?:{FEMALE})\.? $"), "f").when(title.rlike(rf"^(?:{MALE})\.? $"), "m").otherwise("n")
    script = F.when(han, "h").when(name.rlike(r"\p{IsCyrillic}"), "c").when(name.rlike(r"\p{IsGreek}"), "g").when(name.rlike(f"^{_UNCASED}"), "o").otherwise("l")
    given = F.struct(F.lit(2).alias("part"), F.concat(F.lit("given_"), script).alias("kind"), F.lower(F.get(names, F.lit(0))).alias("norm"), gender.alias("gender"))
    value = F.regexp_extract(raw, r"([^\s\"'<>:=]+[^\s\"'<>]*)$", 1)
    family = one(F.concat(F.lit("family_"), script), F.lower(F.element_at(names, -1)))
    return (
        F.when(kind == "person", F.when(F.size(names) > 1, F.array(family, given)).otherwise(F.array(family)))
        .when(kind == "phone", F.array(one(kind, phone)))
        .when(kind.isin("card", "ssn"), F.array(one(kind, digits)))
        .when(kind == "iban", F.array(one(kind, F.regexp_replace(raw, " ", ""))))
        .when(kind.isin("email", "hex", "ipv6", "mac"), F.array(one(kind, F.lower(raw))))
        .when(kind == "labelled", F.array(F.when(value.rlike("^(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})$"), one(F.lit("hex"), F.lower(value))).otherwise(one(F.lit("key"), value))))
        .otherwise(F.array(one(kind, raw)))
    )


def _name(stream: Column, attempt: Column, names: tuple[str, ...], start: int | Column, glue: str) -> Column:
    """Some of the names in a row; later attempts take more of them, so there is always another."""
    all_ = F.array(*[F.lit(x) for x in names])
    first = F.lit(start) if isinstance(start, int) else start
    return F.array_join(F.transform(F.sequence(F.lit(1), first + F.floor(attempt / 2).cast("int")), lambda i: F.get(all_, F.pmod(_byte(stream, i), F.lit(len(names))).cast("int"))), glue)


def replacement(kind: Column, norm: Column, gender: Column, attempt: Column, key: str) -> Column:
    """The keyed replacement of a component (an attempt's number picks another); ``gender`` (f, m or n) picks a given name."""
    seed = F.concat_ws("\u001f", F.lit(key), kind, norm, attempt.cast("string"))
    stream = F.concat(F.sha2(seed, 512), F.sha2(F.concat(seed, F.lit("+")), 512))
    mixed = _scramble(norm, stream)
    card = F.concat(F.substring(norm, 1, 1), mixed.substr(F.lit(2), F.length(norm) - 2))
    check = F.pmod(10 - _luhn(F.concat(card, F.lit("0"))), F.lit(10)).cast("int").cast("string")
    valid = F.when(_luhn(norm) == 0, F.concat(card, check)).otherwise(F.concat(card, F.pmod(check.cast("int") + 1 + F.pmod(_byte(stream, F.lit(99)), F.lit(9)), F.lit(10)).cast("int").cast("string")))
    phone = F.when(F.length(norm) == 10, F.concat(F.when(norm.startswith("0"), F.concat(F.lit("0"), _pick("123456789", _byte(stream, F.lit(100))))).otherwise(F.concat(_pick("23456789", _byte(stream, F.lit(100))), mixed.substr(F.lit(2), F.lit(1)))), mixed.substr(F.lit(3), F.lit(8)))).otherwise(F.concat(F.substring(norm, 1, 2), mixed.substr(F.lit(3), F.length(norm))))
    octet = lambda k, lo, n: (F.pmod(_byte(stream, F.lit(k)) * 256 + _byte(stream, F.lit(k + 1)), F.lit(n)) + lo).cast("int").cast("string")
    inside = F.regexp_extract(norm, r"^(?:10\.|127\.|192\.168\.|172\.(?:1[6-9]|2[0-9]|3[01])\.)", 0)
    ip = F.when(inside != "", F.concat(inside, F.array_join(F.slice(F.array(octet(2, 0, 256), octet(4, 0, 256), octet(6, 1, 254)), F.size(F.split(inside, r"\.")) - 1, 3), "."))).otherwise(F.concat_ws(".", octet(0, 11, 110), octet(2, 0, 256), octet(4, 0, 256), octet(6, 1, 254)))
    local = F.substring_index(norm, "@", 1)
    domain = F.sha2(F.concat_ws("\u001f", F.lit(key), F.lit("domain"), F.substring_index(norm, "@", -1)), 512)
    host = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: _pick("abcdefghijklmnopqrstuvwxyz", _byte(F.concat(domain, domain), i))), "")
    email = F.concat(_scramble(local, stream), F.lit("@"), host, F.lit(".example."), F.get(F.array(F.lit("com"), F.lit("net"), F.lit("org")), F.pmod(_byte(F.concat(domain, domain), F.lit(20)), F.lit(3)).cast("int")))
    rest = mixed.substr(F.lit(5), F.length(norm))
    iban = F.concat(F.substring(norm, 1, 2), F.lpad((98 - _mod97(F.concat(rest, F.substring(norm, 1, 2), F.lit("00")))).cast("string"), 2, "0"), rest)
    prefix = F.regexp_extract(norm, r"^(?:AKIA|gh[pousr]_|sk-|xox[abprs]-)", 0)
    kept = F.concat(prefix, mixed.substr(F.length(prefix) + 1, F.length(norm)))
    out = F.when(kind.isin("hex", "ipv6", "mac"), _scramble(norm, stream, _HEXES)).when(kind == "ipv4", ip).when(kind == "email", email).when(kind == "card", valid).when(kind == "phone", phone).when(kind == "iban", iban)
    for end, female, male, other in (("l", GIVEN_FEMALE, GIVEN_MALE, GIVEN_OTHER), ("c", CYRILLIC_FEMALE, CYRILLIC_MALE, CYRILLIC_FEMALE + CYRILLIC_MALE), ("g", GREEK_FEMALE, GREEK_MALE, GREEK_FEMALE + GREEK_MALE), ("h", HAN_FEMALE, HAN_MALE, HAN_FEMALE + HAN_MALE)):
        pick = lambda names, end=end: _name(stream, attempt, names, F.length(norm), "") if end == "h" else _name(stream, attempt, names, 1, "-")
        out = out.when(kind == f"given_{end}", F.when(gender == "f", pick(female)).when(gender == "m", pick(male)).otherwise(pick(other)))
    for end, names in (("l", SYLLABLES), ("c", CYRILLIC_SYLLABLES), ("g", GREEK_SYLLABLES)):
        out = out.when(kind == f"family_{end}", F.initcap(_name(stream, attempt, names, 3, "")))
    out = out.when(kind == "family_h", _name(stream, attempt, HAN_FAMILY, 1, "")).when(kind.isin("given_o", "family_o"), mixed)
    return out.otherwise(kept)


def _refill(raw: Column, digits: Column) -> Column:
    """Put ``digits`` into the places of the digits of ``raw``, the last in the last place; places before them stay."""
    own = _digits_of(raw)
    full = F.concat(own.substr(F.lit(1), F.length(own) - F.length(digits)), digits)

    def one(i: Column) -> Column:
        c = _at(raw, i)
        return F.when(c.rlike("[0-9]"), _at(full, F.length(_digits_of(raw.substr(F.lit(1), i))))).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(raw)), one), "")


def _refill_words(raw: Column, flat: Column) -> Column:
    """Put the characters of ``flat`` into ``raw``, whose blanks stay."""
    one = lambda i: F.when(_at(raw, i) == " ", " ").otherwise(_at(flat, F.length(F.regexp_replace(raw.substr(F.lit(1), i), " ", ""))))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(raw)), one), "")


def render(kind: Column, raw: Column, first: Column, second: Column) -> Column:
    """An entity in its own format, with the replacements of its parts 1 and 2."""
    is_loud = lambda s: (s == F.upper(s)) & (s != F.lower(s))
    loud = is_loud(raw)
    tail = raw.substr(F.length(raw) - F.length(first) + 1, F.length(raw))
    title = _title(raw)
    bare = raw.substr(F.length(title) + 1, F.length(raw))
    name = F.when(bare.rlike(f"^{_HAN}$"), F.concat(first, second)).otherwise(F.concat_ws(" ", second, first))
    name_loud = bare == F.upper(bare)
    return (
        F.when(kind == "person", F.concat(title, F.when(name_loud, F.upper(name)).otherwise(name)))
        .when(kind.isin("phone", "card", "ssn"), _refill(raw, first))
        .when(kind == "iban", _refill_words(raw, first))
        .when(kind.isin("email", "hex", "ipv6", "mac"), F.when(loud, F.upper(first)).otherwise(first))
        .when(kind == "labelled", F.concat(raw.substr(F.lit(1), F.length(raw) - F.length(first)), F.when(is_loud(tail) & tail.rlike("^[0-9A-F]{32,128}$"), F.upper(first)).otherwise(first)))
        .otherwise(first)
    )


def spread(rows: DataFrame) -> DataFrame:
    """A small written table, dealt over as many tasks as its rows deserve: surrogates cost far more than reading them."""
    return rows.repartition(min(rows.count() // ROWS_A_TASK + 1, max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))))


def assign(parts: DataFrame, key: str) -> DataFrame:
    """(kind, norm, core) for all distinct (kind, norm): distinct within the kind, and none is a real component."""
    f, m = F.count_if(F.col("gender") == "f"), F.count_if(F.col("gender") == "m")
    real = parts.groupBy("kind", "norm").agg(f.alias("f"), m.alias("m"))
    real = real.select("kind", "norm", F.when(F.col("f") > F.col("m"), "f").when(F.col("m") > F.col("f"), "m").otherwise("n").alias("gender"))
    real = materialise(real, "pii-parts")
    known = real.select("kind", F.col("norm").alias("core"))
    open_, done = real, None
    for attempt in range(ATTEMPTS):
        cand = spread(open_).withColumn("core", replacement(F.col("kind"), F.col("norm"), F.col("gender"), F.lit(attempt), key))
        cand = materialise(cand, "pii-candidates")
        taken = known.select("kind", F.lower("core").alias("core"), F.lit("").alias("who"))
        if done is not None:
            taken = taken.union(done.select("kind", F.lower("core"), F.lit("")))
        owner = taken.union(cand.select("kind", F.lower("core"), "norm")).groupBy("kind", "core").agg(F.min("who").alias("who"))
        judged = cand.join(owner.withColumnRenamed("core", "low"), (cand.kind == owner.kind) & (F.lower(cand.core) == F.col("low"))).select(cand.kind, cand.norm, cand.gender, cand.core, (F.col("who") == cand.norm).alias("ok"))
        judged = materialise(judged, "pii-judged")
        good = judged.where("ok").select("kind", "norm", "core")
        done = good if done is None else done.union(good)
        open_ = judged.where("not ok").select("kind", "norm", "gender")
        if open_.isEmpty():
            return done
    raise RuntimeError(f"replacements still collide after {ATTEMPTS} attempts")


def dictionary(raws: DataFrame, key: str) -> DataFrame:
    """(raw, kind, surrogate) of the distinct entities ``raw``."""
    raws = materialise(raws.select("raw").distinct(), "pii-raw")
    raws = spread(raws).withColumn("kind", kind_of(F.col("raw")))
    parts = raws.select("raw", F.col("kind").alias("whole"), F.explode(components(F.col("kind"), F.col("raw"))).alias("c")).select("raw", "whole", "c.*")
    parts = materialise(parts, "pii-split")
    cores = assign(parts, key)
    found = parts.drop("gender").join(cores, ["kind", "norm"]).groupBy("raw", "whole").agg(F.max(F.when(F.col("part") == 1, F.col("core"))).alias("a"), F.max(F.when(F.col("part") == 2, F.col("core"))).alias("b"))
    found = spread(materialise(found, "pii-cores"))
    return found.select("raw", F.col("whole").alias("kind"), render(F.col("whole"), F.col("raw"), F.col("a"), F.col("b")).alias("surrogate"))


def mentions(named: DataFrame) -> DataFrame:
    """(id, raw, surrogate) of the full names, surnames and given names of each text's persons, from (id, raw, surrogate)."""
    bare = lambda c: F.substring(c, F.length(_title(c)) + 1, F.length(c))
    last, first = (lambda c: F.element_at(F.split(c, " "), -1)), (lambda c: F.element_at(F.split(c, " "), 1))
    both = named.where(F.col("raw").rlike(f"^(?:{PERSON}|{_HAN})$")).select("id", bare(F.col("raw")).alias("n"), bare(F.col("surrogate")).alias("s"))
    n, s = F.col("n"), F.col("s")
    stem = lambda c: F.regexp_replace(c, "['’][sS]?$", "")
    given = F.when(n.rlike(r"^\p{IsHan}{3,}$"), F.substring(n, 2, 9)).when(n.contains(" "), first(n))
    new = F.when(n.rlike(r"^\p{IsHan}{3,}$"), s.substr(F.length(s) - F.length(given) + 1, F.length(given))).otherwise(first(s))
    forms = []
    for a, b in ((n, s), (last(n), last(s)), (given, new), (stem(n), s), (stem(last(n)), last(s)), (stem(given), new)):
        forms += [(a, b), (F.upper(a), F.upper(b)), (F.when(a == F.upper(a), F.initcap(a)), F.initcap(b))]
    rows = F.array(*[F.struct(F.lit(k).alias("k"), a.alias("raw"), b.alias("surrogate")) for k, (a, b) in enumerate(forms)])
    each = both.select("id", F.explode(rows).alias("x")).where("length(x.raw) > 1")
    return each.groupBy("id", F.col("x.raw").alias("raw")).agg(F.min(F.struct("x.k", "x.surrogate")).alias("y")).select("id", "raw", F.col("y.surrogate").alias("surrogate"))


def replace(docs: DataFrame, text: str = "text", key: str = "surrogates") -> DataFrame:
    """``docs`` with surrogates in ``text`` and a column n_entities; ``key`` is the secret of the replacements.

    One pass finds the entities. Rows of one text share them, so they are looked up once for each distinct text that has
    any; a second pass brings them to the texts and cuts those texts only.
    """
    id_ = F.md5(F.col(text).cast("binary"))
    found = docs.select(id_.alias("id"), entities(F.col(text)).alias("e"), F.col(text).alias("t")).where(F.size("e") > 0)
    # Of runs of digits only those that are card numbers; the others stay in ``e``, as it goes with the text's pieces.
    numbers = F.filter("e", plain_number)
    told = F.when(F.size(numbers) > 0, told_cards(F.col("t"))).otherwise(F.array().cast("array<string>"))
    found = found.select("id", "e", F.array_except(F.array_distinct("e"), F.array_except(numbers, told)).alias("k")).where(F.size("k") > 0)
    found = materialise(found.groupBy("id").agg(F.first("e").alias("e"), F.first("k").alias("k")), "pii-found")
    asked = found.select("id", F.explode("k").alias("raw"))
    book = materialise(dictionary(asked, key).select("raw", "surrogate"), "pii-dictionary")
    named = materialise(asked.join(book, "raw").select("id", "raw", "surrogate"), "pii-named")
    table = lambda rows, name: rows.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("raw", "surrogate"))).alias(name))
    by_text = found.join(table(named, "__m"), "id").join(table(mentions(named), "__n"), "id", "left")
    # Longer names first; they hold letters, marks, apostrophes, hyphens and blanks only. Han names need no blanks around.
    whole = lambda x: F.when(x.rlike(r"^\p{IsHan}+$"), x).otherwise(F.concat(F.lit(_B), x, F.lit(_E)))
    names = F.array_join(F.transform(F.array_sort(F.transform(F.map_keys("__n"), lambda x: F.struct((-F.length(x)).alias("k"), x.alias("x")))), lambda y: whole(y["x"])), "|")
    by_text = by_text.withColumn("__w", names)
    by_text = materialise(by_text.select(F.col("id").alias("__id"), F.col("e").alias("__e"), "__m", "__n", "__w"), "pii-by-text")
    out = docs.join(small(by_text), id_ == F.col("__id"), "left")
    hits = lambda p: F.concat(F.array(F.lit("")), F.regexp_extract_all(p, F.col("__w"), F.lit(0)))
    again = lambda p: F.array_join(F.zip_with(hits(p), F.split(p, F.col("__w"), -1), lambda h, x: F.concat(F.coalesce(F.col("__n")[h], h), x)), "")
    rest = lambda p: F.when(F.col("__w").isNull(), p).otherwise(again(p))
    swap = lambda p, i: F.when(i == 0, rest(p)).otherwise(F.concat(F.coalesce(F.col("__m")[F.get(F.col("__e"), i - 1)], F.get(F.col("__e"), i - 1)), rest(p)))
    more = F.aggregate(F.split(F.col(text), ANY, -1), F.lit(0), lambda a, p: a + F.regexp_count(p, F.col("__w")))
    n = F.size(F.filter("__e", lambda x: F.map_contains_key(F.col("__m"), x))) + F.when(F.col("__w").isNull(), 0).otherwise(more)
    new = F.when(F.col("__id").isNull(), F.col(text)).otherwise(F.array_join(F.transform(F.split(F.col(text), ANY, -1), swap), ""))
    plain = [c for c in docs.columns if c != "n_entities"]
    return out.select(*[new.alias(text) if c == text else F.col(c) for c in plain], F.when(F.col("__id").isNull(), 0).otherwise(n).alias("n_entities"))
