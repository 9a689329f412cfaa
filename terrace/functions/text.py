"""Text predicates and normalisers as column expressions.

Python's blanks and digits are Unicode, so patterns carry ``(?U)``. Null texts are empty unless stated otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Punctuation that normalisation removes, separators of keywords, ends of sentences.
PUNCTUATION = "，。！？；：、,.!?;:~～…—-（）()【】[]《》<>“”\"‘’'`"
KEYWORD_BREAKS = r"(?U)[\s,，。！？；：、（）()\"“”'‘’]+"
TERMINALS = "。！？；：.!?:;"
NUMERAL = "一二两三四五六七八九十百千0-9"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text_or_empty(c: Column | str) -> Column:
    return F.coalesce(col(c).cast("string"), F.lit(""))


def strip(c: Column | str) -> Column:
    """Without Unicode blanks at the ends."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def squeeze(c: Column | str) -> Column:
    """Without any blanks."""
    return F.regexp_replace(col(c), r"(?U)\s+", "")


def normalise(c: Column | str) -> Column:
    """Lower case without blanks and punctuation."""
    return F.translate(squeeze(F.lower(text_or_empty(c))), PUNCTUATION, "")


# Punctuation that evaluation ignores, and marks of answer templates.
EVAL_PUNCTUATION = "!！?？,，.。~～、:：;；'\"“”‘’（）()-[]{}"
TEMPLATE_MARKS = (
    (r"【直接依据】|【推理/判断】|【结论】", "\n"),
    (r"(?im)^(结论|依据|补充说明)\s*[:：]\s*", ""),
    (r"《[^》]+》", ""),
    (r"(?im)^\s*(相关条款|最终结论|直接适用或参照理解|必要时简要说明判断过程)\s*$", ""),
    (r"(?im)^\s*[-*•]\s*", ""),
    (r"(?im)^\s*[0-9]+\.\s*", ""),
)


def normalise_for_eval(c: Column | str) -> Column:
    """Lower case without blanks and the wider set of punctuation."""
    return F.translate(squeeze(F.lower(text_or_empty(c))), EVAL_PUNCTUATION, "")


def answer_for_compare(c: Column | str, every_line: bool = True) -> Column:
    """An answer without template marks, titles and bullets, normalised; marks of lines go from the first line alone unless ``every_line``."""
    out = text_or_empty(c)
    for pattern, to in TEMPLATE_MARKS:
        out = F.regexp_replace(out, pattern if every_line else pattern.replace("(?im)", "(?id)"), to)  # d: only a line feed may follow the end
    return normalise_for_eval(out)


def clean_lines(c: Column | str) -> Column:
    """The lines, stripped, without empty ones."""
    return F.filter(F.transform(F.split(text_or_empty(c), "\n"), strip), lambda x: x != "")


def contains_any(c: Column, words: Sequence[str]) -> Column:
    """Whether any of the words is in the text; false for no words."""
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def starts_any(c: Column, words: Sequence[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.startswith(w)
    return out


def ends_any(c: Column, words: Sequence[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.endswith(w)
    return out


def hits(text: Column, keywords: Column) -> Column:
    """How many of an array of keywords are in the text; an empty keyword counts for nothing."""
    return F.size(F.filter(F.coalesce(keywords, F.array().cast("array<string>")), lambda k: (k != "") & F.contains(text_or_empty(text), k)))


def occurrences(text: Column, word: Column) -> Column:
    """Non-overlapping occurrences of a word that isn't empty."""
    return F.when(F.length(word) > 0, (F.length(text) - F.length(F.replace(text, word, F.lit("")))) / F.length(word)).otherwise(0).cast("long")


def keywords(*texts: Column | str) -> Column:
    """Distinct words of two characters or more, in order of appearance."""
    joined = F.concat_ws(" ", *[text_or_empty(t) for t in texts])
    return F.array_distinct(F.filter(F.split(joined, KEYWORD_BREAKS), lambda w: F.length(w) >= 2))


def clauses(c: Column | str) -> Column:
    """Parts between punctuation marks, normalised, without empty ones."""
    return F.filter(F.transform(F.split(text_or_empty(c), r"[，。！？；,.!?;~～\n]+"), normalise), lambda x: x != "")


def terms(c: Column | str) -> Column:
    """Distinct lower-case runs of letters, digits and underscores, or of two Chinese characters or more."""
    found = F.regexp_extract_all(F.lower(text_or_empty(c)), F.lit("[a-z0-9_]{2,}|[\\u4e00-\\u9fff]{2,}"), F.lit(0))
    return F.array_distinct(found)


def numeral(c: Column | str) -> Column:
    """Value of a Chinese or decimal numeral; null where it is none."""
    value = text_or_empty(c)
    digits = "零一二三四五六七八九"
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("now"))

    def step(acc: Column, ch: Column) -> Column:
        digit = F.when(ch == "两", F.lit(2)).otherwise(F.instr(F.lit(digits), ch) - 1).cast("long")
        unit = F.when(ch == "十", 10).when(ch == "百", 100).when(ch == "千", 1000).cast("long")
        taken = F.when(acc["now"] == 0, F.lit(1).cast("long")).otherwise(acc["now"])
        return F.when(unit.isNotNull(), F.struct((acc["total"] + taken * unit).alias("total"), F.lit(0).cast("long").alias("now"))).otherwise(F.struct(acc["total"].alias("total"), digit.alias("now")))

    folded = F.aggregate(F.split(value, ""), start, lambda acc, ch: F.when(ch == "", acc).otherwise(step(acc, ch)), lambda acc: acc["total"] + acc["now"])
    return F.when(value.rlike("^[0-9]+$"), F.try_to_number(value, F.lit("999999999999999999")).cast("long")).when(value.rlike("^[零一二两三四五六七八九十百千]+$"), folded)


def leading_article(c: Column | str) -> Column:
    """Number of the article that the text begins with; null otherwise."""
    return numeral(F.nullif(F.regexp_extract(strip(text_or_empty(c)), f"^第([{NUMERAL}]+)条", 1), F.lit("")))


def own_article(c: Column | str) -> Column:
    """Number of the article that the text begins with, or else of the first one named in its first 120 characters."""
    first = numeral(F.nullif(F.regexp_extract(F.substring(strip(text_or_empty(c)), 1, 120), f"第([{NUMERAL}]+)条", 1), F.lit("")))
    return F.coalesce(leading_article(c), first)


# Words that announce a reference to another article, and where the announcement ends.
REFERENCE_WORDS = ("详见", "参见", "另见", "见第", "按照", "依照", "依据", "根据", "适用", "参照", "遵照", "按第")
REFERENCE_ENDS, REFERENCE_SIZE = "。；;\\n", 90


def referenced_articles(c: Column | str) -> Column:
    """Distinct numbers of the articles named within 90 characters from a word of reference on, up to the end of its clause.

    Every announcement has a window of its own, so windows may overlap; a word that begins inside another counts with it.
    """
    words = "|".join(f"(?<![详参另]){w}" if w == "见第" else w for w in REFERENCE_WORDS)
    windows = F.regexp_extract_all(text_or_empty(c), F.lit(f"(?=((?:{words})[^{REFERENCE_ENDS}]{{0,{REFERENCE_SIZE - 2}}}))"), F.lit(1))
    named = F.flatten(F.transform(windows, lambda w: F.regexp_extract_all(w, F.lit(f"第([{NUMERAL}]+)条"), F.lit(1))))
    return F.array_distinct(F.filter(F.transform(named, numeral), lambda x: x.isNotNull()))


def collection_name(c: Column | str) -> Column:
    return F.regexp_replace(text_or_empty(c), "[^A-Za-z0-9]", "_")


def title(c: Column | str, default: str = "New conversation", size: int = 50) -> Column:
    """The first characters with runs of blanks as one space, or the default where nothing is left."""
    return F.coalesce(F.nullif(F.substring(strip(F.regexp_replace(text_or_empty(c), r"(?U)\s+", " ")), 1, size), F.lit("")), F.lit(default))


def without_thoughts(c: Column | str) -> Column:
    """Without <think> blocks."""
    return strip(F.regexp_replace(text_or_empty(c), r"(?is)<think>.*?</think>", ""))


def stem(c: Column | str) -> Column:
    """File name without folders and suffix."""
    return F.regexp_replace(F.regexp_replace(text_or_empty(c), r"^.*[/\\]", ""), r"(?<=.)\.[^.]*$", "")


def suffix(c: Column | str) -> Column:
    return F.lower(F.regexp_extract(text_or_empty(c), r"[^/\\](\.[^./\\]+)$", 1))


def split_parent(c: Column | str) -> Column:
    """(base, index) of an id like base_3; null for others."""
    found = F.regexp_extract(text_or_empty(c), "^(.+)_([0-9]{1,9})$", 2)
    return F.when(found != "", F.struct(F.regexp_extract(text_or_empty(c), "^(.+)_([0-9]{1,9})$", 1).alias("base"), found.cast("int").alias("index")))
