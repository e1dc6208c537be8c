"""Text rules as column functions; all of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values -------------------------------------------------------------------------------
#: Characters that count as white space at the ends of a text and in titles.
SPACE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A chapter heading, as a whole line.
HEADING = r"(?iuU)^\s*(第\s*[0-9一二三四五六七八九十百千]+\s*[章节回]|Chapter\s+\d+)\b.*$"
#: Titles of back matter, cleaned and in lower case.
BACK_MATTER = ("索引", "参考书目", "index", "bibliography")
#: Titles that give no keywords.
COPYRIGHT = ("版权信息", "copyright")
#: Characters that mark a title as traditional Chinese where no converter is installed.
TRADITIONAL = (
    "書電來說話這個時會對學問國務現實際應當來們點進開關處還"
    "歡樂體動設計資訊傳說標準環境網絡變換預算發展運動認識"
    "義務條件結構機制選擇統計監督繼續識別溝通維護數據處理"
    "歷史文化藝術哲學經濟組織機構協議協作協調決策執行方針"
    "與並從內外長短廣狹強弱快慢遠近輕重高低深淺寬窄早晚"
    "後前左右東西南北上下中外新舊多少大小"
)
KANA = r"[\u3040-\u30ff]"
HAN = r"[\u4e00-\u9fff\u3400-\u4dbf]"
# ---------------------------------------------------------------------------------------------


def strip(text: Column) -> Column:
    """The text without white space at its ends, by code points rather than spaces alone."""
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")


def clean_whitespace(text: Column) -> Column:
    """No blanks before line ends, at most one empty line in a row, nothing at the ends."""
    return strip(F.regexp_replace(F.regexp_replace(text, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n"))


def clean_title(title: Column) -> Column:
    """The title without any white space."""
    return F.regexp_replace(F.coalesce(title, F.lit("")), f"[{SPACE}]+", "")


def is_heading(line: Column) -> Column:
    return F.coalesce(line, F.lit("")).rlike(HEADING)


def is_back_matter(title: Column) -> Column:
    return F.lower(clean_title(title)).isin(*BACK_MATTER)


def is_copyright_title(title: Column) -> Column:
    low = F.lower(strip(F.coalesce(title, F.lit(""))))
    return low.contains(COPYRIGHT[0]) | low.contains(COPYRIGHT[1])


def title_language(title: Column) -> Column:
    """zha, zho, jpn or null, by the characters of a title."""
    t = F.coalesce(title, F.lit(""))
    return (
        F.when(~t.rlike(r"[^\x00-\x7f]"), None)
        .when(t.rlike(f"[{TRADITIONAL}]"), "zha")
        .when(t.rlike(KANA), "jpn")
        .when(t.rlike(HAN), "zho")
    )


def book_language(declared: Column, title: Column) -> Column:
    """The language of the title where its characters tell, else the declared one, else English: files often declare a wrong one."""
    return F.coalesce(title_language(title), F.nullif(declared, F.lit("")), F.lit("eng"))


def language_bucket(language: Column) -> Column:
    return F.when(F.lower(F.trim(F.coalesce(language, F.lit("")))) == "eng", "en").otherwise("zh")


def han_pairs(tokens: Column) -> Column:
    """Tokens in which a run of Han characters becomes its pairs of neighbours; a single one stays.

    Chinese has no spaces; pairs find the words of a query in any clause, where no dictionary is
    at hand (``operators.lattice`` learns one). Tokens with Han beside other characters are cut
    where the script changes.
    """
    def cut(token: Column) -> Column:
        runs = F.regexp_extract_all(token, F.lit(f"{HAN}+|[^{HAN[1:-1]}]+"), F.lit(0))
        pairs = lambda r: F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - 1, F.lit(1))), lambda i: F.substring(r, i, F.lit(2)))
        return F.flatten(F.transform(runs, lambda r: F.when(r.rlike(f"^{HAN}"), pairs(r)).otherwise(F.array(r))))

    return F.flatten(F.transform(tokens, cut))


def with_han_pairs(text: Column, tokens: Column) -> Column:
    """``tokens`` of ``text``, with pairs of Han characters if the text has any: it is asked once, not each token."""
    return F.when(text.rlike(HAN), han_pairs(tokens)).otherwise(tokens)


def tokens(text: Column) -> Column:
    """Lower-case runs of word characters in any script; of Han runs the pairs of neighbours."""
    text = F.coalesce(text, F.lit(""))
    return with_han_pairs(text, F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w+"), F.lit(0)))


def hash_embedding(text: Column, dimensions: int = 8) -> Column:
    """A deterministic vector: the bytes of the text's SHA-256, as (byte - 128) / 128."""
    digest = F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)
    byte = [F.conv(F.substring(digest, 2 * (i % 32) + 1, 2), 16, 10).cast("double") for i in range(dimensions)]
    return F.array(*((b - 128.0) / 128.0 for b in byte))


def token_digest(token: Column) -> Column:
    return F.sha2(token.cast("binary"), 256)


def mask_token(token: Column) -> Column:
    return F.concat(F.lit("•" * 8), F.right(token, F.lit(4)))


#: Language names by code.
LANGUAGE_NAMES = {"eng": "English", "deu": "German", "fra": "French", "spa": "Spanish", "zho": "Chinese", "jpn": "Japanese"}


def language_name(code: Column) -> Column:
    """The language's name, or the code itself."""
    names = F.create_map(*(F.lit(x) for pair in LANGUAGE_NAMES.items() for x in pair))
    return F.coalesce(F.try_element_at(names, code), code)
