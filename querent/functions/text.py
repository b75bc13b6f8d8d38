"""Text functions as Column expressions: nouns, filters, identifiers, SQL answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Generic Vietnamese terms that never name a schema item.
STOPWORDS = (
    "hiển thị", "liệt kê", "cho biết", "vui lòng", "trả về", "tìm", "đếm", "sắp xếp",
    "số lượng", "tổng số", "số", "tổng", "tổng cộng", "giá trị", "mức", "lượt", "thứ tự",
    "khoảng", "lần", "tên", "loại", "bộ", "phần", "chiếc", "việc", "sức", "cấp", "con", "năm",
)

#: Vietnamese letters with marks (precomposed; the upper case follows).
MARKED = "ăâđêôơưáàảãạắằẳẵặấầẩẫậéèẻẽẹếềểễệíìỉĩịóòỏõọốồổỗộớờởỡợúùủũụứừửữựýỳỷỹỵ"

#: Why a noun is filtered, in the order in which reasons apply.
REASONS = ("too_short_removed", "too_long_removed", "vietnamese_stopwords_removed", "schema_name_duplicates_removed", "english_nouns_removed")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is made once, however often the body has it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """Stripped, and inner white space as single blanks."""
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def unique(items: Column) -> Column:
    """Stripped items without empty ones and repeats, in order of first appearance."""
    return F.array_distinct(F.filter(F.transform(items, strip), lambda x: x != ""))


def is_noun_tag(tag: Column) -> Column:
    return tag.startswith("N")


def noun_candidates(tagged: Column, phrases: bool = True) -> Column:
    """Nouns of an array<struct<token, tag>>, and runs of two or more as phrases.

    A run's phrase comes where the run ends, after its nouns.  Nouns are placed
    first and cut where places do not follow one another, so that work grows
    with the tokens.
    """
    placed = F.filter(F.transform(tagged, lambda x, i: F.struct(i.alias("pos"), x["token"].alias("token"), x["tag"].alias("tag"))), lambda x: is_noun_tag(x["tag"]))
    own = F.filter(F.transform(placed, lambda x: F.struct(x["pos"].alias("pos"), strip(x["token"]).alias("token"))), lambda x: x["token"] != "")
    if not phrases:
        return F.array_distinct(F.transform(own, lambda x: x["token"]))
    follows = lambda n, x, i: F.coalesce(F.get(n, i - 1)["pos"] == x["pos"] - 1, F.lit(False))
    starts = lambda n: F.filter(F.transform(n, lambda x, i: F.when(~follows(n, x, i), i)), lambda i: i.isNotNull())
    whole = lambda r: F.when(F.size(r) >= 2, F.concat(r, F.array(F.array_join(r, " ")))).otherwise(r)
    cut = lambda n, s: F.transform(s, lambda at, k: F.transform(F.slice(n, at + 1, F.coalesce(F.get(s, k + 1), F.size(n)) - at), lambda x: x["token"]))
    return F.array_distinct(let(own, lambda n: let(starts(n), lambda s: F.flatten(F.transform(cut(n, s), whole)))))


def nouns(tagged: Column) -> Column:
    return noun_candidates(tagged, phrases=False)


def schema_name(name: Column) -> Column:
    """Underscores as blanks, lower-cased, single-spaced."""
    return squeeze(F.lower(F.replace(name, F.lit("_"), F.lit(" "))))


def has_mark(text: Column) -> Column:
    #: One test of the range keeps all other characters from the long class.
    return text.rlike(f"(?=[\u00c0-\u1ef9])[{MARKED}{MARKED.upper()}]")


def ascii_letter_ratio(text: Column) -> Column:
    """ASCII letters among all letters; 0 without letters.

    Each count is made once: other letters are looked for in what is left
    without ASCII, and a null quotient stands for no letters.
    """
    ascii_letters = F.length(F.regexp_replace(text, "[^a-zA-Z]++", ""))
    others = F.length(F.regexp_replace(F.regexp_replace(text, r"[\x00-\x7f]++", ""), r"[^\p{L}]++", ""))
    return F.coalesce(F.try_divide(ascii_letters.cast("double"), ascii_letters + others), F.lit(0.0))


def is_stopword(noun: Column) -> Column:
    return strip(F.lower(noun)).isin(*STOPWORDS)


def filter_reason(noun: Column, names: Column | None = None, named: Column | None = None) -> Column:
    """The first reason to drop a noun, or an empty string.

    ``names`` is an array of the database's table and column names, or ``named``
    tells whether the noun is one of them.
    """
    s = strip(noun)
    out = F.when(F.length(s) < 2, REASONS[0]).when(F.length(s) > 30, REASONS[1]).when(is_stopword(s), REASONS[2])
    if names is not None:
        variants = F.array_union(F.transform(names, F.lower), F.transform(names, schema_name))
        named = F.array_contains(variants, schema_name(s)) | F.array_contains(variants, F.lower(s))
    if named is not None:
        out = out.when(named, REASONS[3])
    return out.when((ascii_letter_ratio(s) > 0.70) & ~has_mark(s), REASONS[4]).otherwise("")


def is_plain(noun: Column) -> Column:
    """Whether no reason but a schema name drops a stripped noun; false for null.

    Cheap tests come first: letters of a text in ASCII are all ASCII letters.
    Of 30 characters at most, more than 0.70 are ASCII letters where 3 times
    their number is more than 7 times that of the others.
    """
    n = F.length(noun)
    ascii_letters = F.length(F.regexp_replace(noun, "[^a-zA-Z]++", ""))
    others = F.length(F.regexp_replace(F.regexp_replace(noun, r"[\x00-\x7f]++", ""), r"[^\p{L}]++", ""))
    english = F.when(n == F.octet_length(noun), noun.rlike("[a-zA-Z]")).otherwise(~has_mark(noun) & (3 * ascii_letters > 7 * others))
    return F.coalesce((n >= 2) & (n <= 30) & ~english & ~F.lower(noun).isin(*STOPWORDS), F.lit(False))


def is_kept(noun: Column, names: Column | None = None) -> Column:
    return filter_reason(noun, names) == ""


def kept_nouns(items: Column, names: Column | None = None) -> Column:
    """The nouns of an array that stay, without repeats."""
    return unique(F.filter(items, lambda x: is_kept(x, names)))


def clean_identifier(name: Column) -> Column:
    """Words of an identifier: parted at underscores and before inner capitals."""
    return squeeze(F.lower(F.regexp_replace(F.replace(name, F.lit("_"), F.lit(" ")), "(?<=[a-z0-9])(?=[A-Z])", " ")))


def extract_sql(text: Column) -> Column:
    """The statement in a model's answer, from WITH or SELECT to a semicolon or the end.

    Without one, the whole answer in single spaces.  Code fences go first.
    """
    bare = F.regexp_replace(F.regexp_replace(text, r"(?U)```sql\s*", ""), r"(?U)```\s*", "")
    found = F.regexp_extract(bare, r"(?is)((?:WITH|SELECT).*?)(?:;|\z)", 1)
    return F.when(found != "", strip(found)).otherwise(squeeze(bare))


def prediction(text: Column) -> Column:
    """The extracted statement on one line."""
    return squeeze(extract_sql(text))


def threshold_tag(value: Column) -> Column:
    """0.85 as t085."""
    return F.replace(F.format_string("t%.2f", value.cast("double")), F.lit("."), F.lit(""))
