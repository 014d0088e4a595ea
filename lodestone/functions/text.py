"""String functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = "\\u3400-\\u4dbf\\u4e00-\\u9fff"


def squeeze(c: Column) -> Column:
    """Runs of white space (of any script) as one space, trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def strip(c: Column) -> Column:
    """Trimmed of white space of any kind."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clipped(c: Column, chars: Column) -> Column:
    """Text cut to so many characters, the last three of them dots if there is room."""
    cut = F.when(chars <= 3, F.substring(c, F.lit(1), chars)).otherwise(F.concat(F.substring(c, F.lit(1), chars - 3), F.lit("...")))
    return F.when(chars <= 0, "").when(F.length(c) <= chars, c).otherwise(cut)


def fold(c: Column) -> Column:
    """Case folding: lower case, sharp s as ss."""
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def language(c: Column) -> Column:
    """zh-TW, en or mixed by the scripts in the text; en if neither."""
    cjk, latin = c.rlike(f"[{CJK}]"), c.rlike("[A-Za-z]")
    return F.when(cjk & latin, "mixed").when(cjk, "zh-TW").otherwise("en")


def query_tokens(c: Column) -> Column:
    """Distinct folded words, and runs of Han characters with their bigrams, in order."""
    raw = F.regexp_extract_all(fold(squeeze(c)), F.lit(f"([A-Za-z0-9][A-Za-z0-9._/-]*|[{CJK}]+)"), F.lit(1))

    def spread(t: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 1, F.lit(1))), lambda i: F.substring(t, i, F.lit(2)))
        return F.when(t.rlike(f"^[{CJK}]"), F.concat(F.array(t), pairs)).otherwise(F.array(t))

    return F.array_distinct(F.flatten(F.transform(raw, spread)))


def occurrences(text: Column, part: Column) -> Column:
    """Non-overlapping occurrences of a non-empty part."""
    return ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("int")


def white_tokens(c: Column) -> Column:
    """Lower-cased tokens between white space, repeats kept."""
    return F.filter(F.split(F.lower(c), r"(?U)\s+"), lambda t: t != "")


def ordered_distinct(items: Column) -> Column:
    """Trimmed non-empty strings, first occurrences in order."""
    return F.array_distinct(F.filter(F.transform(items, lambda x: F.trim(x)), lambda t: t != ""))


def preview(c: Column, chars: int = 120) -> Column:
    """The first characters of the squeezed text."""
    return F.substring(squeeze(c), 1, chars)


def optional(c: Column) -> Column:
    """Trimmed text, null if blank."""
    return F.nullif(F.trim(c), F.lit(""))


def embedding_input(heading: Column, content: Column) -> Column:
    """Heading, blank line, content; parts that are blank fall away."""
    return F.concat_ws("\n\n", optional(heading), optional(content))


def truncated(c: Column, chars: int, suffix: str = "...") -> Column:
    """Text cut to so many characters, the suffix included."""
    if chars <= len(suffix):
        return F.substring(c, 1, chars)
    return F.when(F.length(c) <= chars, c).otherwise(F.concat(F.rtrim(F.substring(c, 1, chars - len(suffix))), F.lit(suffix)))


def _parts(contents: Column) -> Column:
    return F.filter(F.transform(contents, strip), lambda t: t != "")


def merge_texts(contents: Column) -> Column:
    """Trimmed non-blank parts joined by blank lines."""
    return F.array_join(_parts(contents), "\n\n")


def merge_tables(contents: Column) -> Column:
    """Non-blank lines of table parts; of a later part with three lines or more, without its two header lines."""

    def lines(t: Column, i: Column) -> Column:
        held = F.filter(F.transform(F.split(t, "\\r\\n|[\\n\\r\\x0b\\f\\x1c-\\x1e\\x85\\u2028\\u2029]"), lambda x: F.regexp_replace(x, r"(?U)\s+$", "")), lambda x: x != "")
        return F.when((i == 0) | (F.size(held) < 3), held).otherwise(F.slice(held, 3, F.greatest(F.size(held) - 2, F.lit(1))))

    return strip(F.array_join(F.flatten(F.transform(_parts(contents), lines)), "\n"))


def merge_contents(kind: Column, contents: Column) -> Column:
    return F.when(kind == "table", merge_tables(contents)).otherwise(merge_texts(contents))


def handle(document_id: Column) -> Column:
    """doc_ and the url-safe base64 of the id without padding."""
    return F.concat(F.lit("doc_"), F.rtrim(F.translate(F.base64(document_id.cast("string").cast("binary")), "+/", "-_"), F.lit("=")))


def from_handle(h: Column) -> Column:
    """The id of a handle; null if it is not one."""
    body = F.translate(F.substring(h, F.lit(5), F.length(h)), "-_", "+/")
    padded = F.rpad(body, F.length(body) + F.pmod(-F.length(body), F.lit(4)), F.lit("="))
    return F.when(h.startswith("doc_") & body.rlike("^[A-Za-z0-9+/]+$"), F.try_to_binary(padded, F.lit("base64")).cast("string"))


def context_label(index: Column) -> Column:
    return F.concat(F.lit("C"), (index + 1).cast("string"))


#: Version marks at the end of a file name (fixed values).
_VERSION = r"(?:\s*(?:\(\s*(?:\d{2,4}年\d{1,2}月版|\d{2,4}年版|v\d+|V\d+|\d{4}版)\s*\)|(?:v|V)\d+|\d{4}版)\s*)+$"


def document_name(file_name: Column) -> Column:
    """File name without extension and trailing version marks, folded, separators as single spaces."""
    stem = F.regexp_replace(file_name, r"(?<=.)\.[^./\\]+$", "")
    bare = F.trim(F.regexp_replace(F.trim(stem), _VERSION, ""))
    return squeeze(F.regexp_replace(fold(bare), r"[_\-./()\[\]{}]+", " "))


#: Leading instructions of a query (fixed values).
_INSTRUCTION = r"(?i)^\s*(?:請|幫我|麻煩|請幫我)?\s*(?:摘要(?:一下)?|總結(?:一下)?|整理(?:一下)?|概述(?:一下)?|比較(?:一下)?|compare|summarize|summary of|overview of)\s*"


def reference_query(c: Column) -> Column:
    """The query without its leading instruction."""
    q = squeeze(c)
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(q, _INSTRUCTION, "")), F.lit("")), q)


#: Words that do not name a document (fixed values).
GENERIC_TERMS = ["policy", "policies", "doc", "docs", "document", "documents", "file", "files", "guide", "guides", "manual", "report", "reports", "summary", "version", "v1", "v2", "v3", "文件", "檔案", "文檔", "政策", "規範", "規格", "手冊", "流程", "報告", "摘要", "版本"]


def specific_phrase(c: Column) -> Column:
    """Whether a phrase can name a document: a space in it, four Han characters, or eight characters."""
    t = F.trim(c)
    return F.when(t.contains(" "), True).when(t.rlike(f"[{CJK}]"), F.length(t) >= 4).otherwise(F.length(t) >= 8)


def without_generic(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(GENERIC_TERMS))


def phrase_hits(c: Column, han: list[str], latin: list[str]) -> Column:
    """Which trigger phrases the folded text contains: Han ones as they are, Latin ones as whole words."""
    t = fold(c)
    tests = [F.when(t.contains(p), p) for p in han] + [F.when(t.rlike(f"(?<![A-Za-z0-9]){p}(?![A-Za-z0-9])"), p) for p in latin]
    return F.filter(F.array(*tests), lambda x: x.isNotNull())


def sentences(c: Column, lang: Column) -> Column:
    """Sentences: after a full stop, question or exclamation mark and white space, or after a Han full stop."""
    parts = F.when(lang == "zh-TW", F.split(c, "(?<=[。！？；])")).otherwise(F.split(c, r"(?<=[.!?])\s+"))
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda t: t != "")


def clean_pdf_markdown(c: Column) -> Column:
    """Page labels and rules dropped, runs of blank lines as one, trimmed."""
    lines = F.filter(F.split(c, "\n"), lambda x: ~F.trim(x).rlike(r"(?i)^page\s+\d+(\s+of\s+\d+)?$") & ~F.trim(x).rlike(r"^(-{3,}|_{3,}|\*{3,})$"))
    joined = F.regexp_replace(F.array_join(F.transform(lines, lambda x: F.rtrim(x)), "\n"), r"\n{3,}", "\n\n")
    return F.regexp_replace(joined, r"^\s+|\s+$", "")


def answer_blocks(answer: Column) -> Column:
    """array of (text, labels): paragraphs of an answer with their [[C1,C2]] marks taken out."""
    paragraphs = F.filter(F.transform(F.split(answer, r"\n\s*\n"), lambda x: F.trim(x)), lambda t: t != "")
    marks = r"\[\[\s*(C\d+(?:\s*,\s*C\d+)*)\s*\]\]"

    def block(t: Column) -> Column:
        labels = F.array_distinct(F.flatten(F.transform(F.regexp_extract_all(t, F.lit(marks), F.lit(1)), lambda m: F.split(m, r"\s*,\s*"))))
        return F.struct(F.trim(F.regexp_replace(t, r"\s*" + marks, "")).alias("text"), labels.alias("labels"))

    return F.transform(paragraphs, block)


def anchor_tokens(query: Column) -> Column:
    """Distinct folded tokens of two characters or more between white space and marks."""
    return F.array_distinct(F.filter(F.split(fold(query), r"(?U)[\s,.;:!?()\[\]{}\"'`/\\|]+"), lambda t: F.length(t) >= 2))
