"""Scalar text functions, all built from JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Single-character function words of classical Chinese.
CLASSICAL_STOPWORDS = list("之也乎矣焉哉邪耳已而則以且雖若如猶亦故乃夫我吾汝其此彼是有無為曰謂不非所者於豈然得能可將及皆未與")
ENGLISH_STOPWORDS = ["the", "and", "of", "to", "in", "a", "is", "that", "for", "it", "as", "was", "with", "be", "by", "on", "not", "or", "are", "from"]
CONTENT_POS = ["NOUN", "VERB", "ADJ", "PROPN"]

CJK = r"[\x{4e00}-\x{9fff}]"


def is_cjk(s: Column) -> Column:
    """True where s is not empty and all its characters are in U+4E00 to U+9FFF."""
    return s.rlike(f"^{CJK}+$")


def strip(s: Column) -> Column:
    """Without leading and trailing white space of any kind, the ideographic space included."""
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def paragraphs(p: Column) -> Column:
    """Stripped paragraphs, blank ones dropped, joined by a line feed; an empty list is an error."""
    kept = F.filter(F.transform(p, strip), lambda x: x != "")
    return F.when(F.size(p) > 0, F.array_join(kept, "\n")).otherwise(F.raise_error(F.lit("no paragraphs")).cast("string"))


def slug(title: Column, length: int | None = None) -> Column:
    """Lower-case words of a title joined by hyphens, Latin accents folded."""
    accents, plain = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"
    s = F.regexp_replace(F.translate(F.lower(title), accents, plain), "[^a-z0-9]+", "-")
    s = F.regexp_replace(s, "^-+|-+$", "")
    return F.substring(s, 1, length) if length else s


def english_sentences(text: Column) -> Column:
    return F.split(text, r"[.!?\n]+")


def english_tokens(sentence: Column, stopwords: list[str] = ENGLISH_STOPWORDS) -> Column:
    words = F.regexp_extract_all(F.lower(sentence), F.lit("[a-z]+"), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(stopwords)) if stopwords else words


def content_tokens(tagged: Column) -> Column:
    """Lower-cased lemmas of content words from array<struct<lemma, pos, is_stop, is_alpha>>, as a
    tagger adapter supplies them."""
    kept = F.filter(tagged, lambda t: ~t["is_stop"] & t["is_alpha"] & t["pos"].isin(CONTENT_POS))
    return F.transform(kept, lambda t: F.lower(t["lemma"]))


def classical_sentences(text: Column) -> Column:
    return F.split(text, r"[。！？；\n]+")


def classical_tokens(sentence: Column) -> Column:
    return F.regexp_extract_all(sentence, F.lit(CJK), F.lit(0))


def url_host(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("HOST"))


def without_query(url: Column) -> Column:
    return F.regexp_replace(url, r"\?[^#]*", "")


def handle(url: Column) -> Column:
    """@name of a profile URL: its first path segment."""
    return F.concat(F.lit("@"), F.try_element_at(F.split(F.try_parse_url(url, F.lit("PATH")), "/"), F.lit(2)))


def handle_at(urls: Column, suffix: str, host: str) -> Column:
    """@name of the first of an array of URLs whose host ends in suffix or is host; null without one."""
    own = F.filter(urls, lambda u: F.coalesce(url_host(u).endswith(suffix) | (url_host(u) == host), F.lit(False)))
    return handle(F.try_element_at(own, F.lit(1)))


def file_extension(path: Column) -> Column:
    return F.regexp_extract(path, r"\.[A-Za-z0-9]+$", 0)


def file_kind(path: Column) -> Column:
    """pdf, link (pages and paths without an extension) or file."""
    ext = file_extension(path)
    return F.when(ext == ".pdf", F.lit("pdf")).when(ext.isin("", ".html", ".htm"), F.lit("link")).otherwise(F.lit("file"))


def without_prefix(path: Column, prefix: str) -> Column:
    """path without a leading pattern where the rest is a URL by itself, else path as it is."""
    rest = F.regexp_replace(path, f"^{prefix}", "")
    return F.when(url_host(rest).isNotNull(), rest).otherwise(path)


def looked_up(key: Column, names: Column) -> Column:
    """The entry of a map, else the key itself."""
    return F.coalesce(F.try_element_at(names, key), key)


def image_options(size: Column, x: Column, y: Column) -> Column:
    """Display options: only known sizes; a position where either coordinate is given, 50 for absent or 0."""
    placed = F.when(x.isNotNull() | y.isNotNull(), F.array(or_default(x, 50), or_default(y, 50)))
    return F.struct(F.when(size.isin("cover", "contain"), size).alias("size"), placed.alias("position"))


def is_truthy(s: Column) -> Column:
    return F.coalesce(s != "", F.lit(False))


def has_fields(fields: Column, required: list[str]) -> Column:
    """True where a map holds every required field with a value that isn't empty."""
    ok = F.lit(True)
    for k in required:
        ok &= is_truthy(F.try_element_at(fields, F.lit(k)))
    return ok


def has_props(fields: Column, props: list[str]) -> Column:
    """True where a map has all keys, whatever their values."""
    ok = F.lit(True)
    for k in props:
        ok &= F.map_contains_key(fields, k)
    return ok


def rich_text(s: Column) -> Column:
    """A one-paragraph document tree as JSON."""
    leaf = F.struct(F.lit("text").alias("type"), s.alias("text"))
    paragraph = F.struct(F.lit("p").alias("type"), F.array(leaf).alias("children"))
    return F.to_json(F.struct(F.lit("root").alias("type"), F.array(paragraph).alias("children")))


def has_rich_text(tree: Column) -> Column:
    """True where a JSON tree has several children, or one whose first child has a text."""
    kids = F.from_json(F.get_json_object(tree, "$.children"), "array<string>")
    one = is_truthy(F.get_json_object(tree, "$.children[0].children[0].text"))
    return F.coalesce((F.size(kids) > 1) | ((F.size(kids) == 1) & one), F.lit(False))


def form_content(content: Column, status: Column) -> Column:
    """The entry of a status, else the initial one."""
    return F.coalesce(F.try_element_at(content, status), F.try_element_at(content, F.lit("initial")))


def heading(level: Column) -> Column:
    """h1 to h6; deeper levels stay h6."""
    return F.element_at(F.array(*(F.lit(f"h{k}") for k in range(1, 7))), F.least(level, F.lit(6)))


def page_title(title: Column, site: str) -> Column:
    return F.when(title.isNull() | (title == "") | (title == site), F.lit(site)).otherwise(F.concat(title, F.lit(f" – {site}")))


def month_year(ts: Column) -> Column:
    return F.date_format(ts, "MMM yyyy")


def or_default(x: Column, default) -> Column:
    """x, but default where x is null or 0."""
    return F.coalesce(F.nullif(x, F.lit(0)), F.lit(default))


def query_string(pairs: Column) -> Column:
    """array<struct<k, v>> as a URL query."""
    return F.array_join(F.transform(pairs, lambda p: F.concat(F.url_encode(p["k"]), F.lit("="), F.url_encode(p["v"]))), "&")


def stroke_width(weight: Column) -> Column:
    return F.log2(F.coalesce(weight, F.lit(1.0)) + 1) * 0.4


def scaled(percent: Column, extent: Column) -> Column:
    return percent / 100 * extent


def unscaled(pixel: Column, extent: Column) -> Column:
    return pixel / extent * 100


#: Vowels, and the same with tones 1 to 4.
VOWELS = "aeiouüAEIOUÜ"
TONES = ["āēīōūǖĀĒĪŌŪǕ", "áéíóúǘÁÉÍÓÚǗ", "ǎěǐǒǔǚǍĚǏǑǓǙ", "àèìòùǜÀÈÌÒÙǛ"]


def pinyin_syllable(s: Column) -> Column:
    """Numbered pinyin to tone marks: a or e carries the mark, else o before u, else the last vowel."""
    tone = F.regexp_extract(s, "([1-5])$", 1)
    base = F.replace(F.replace(F.regexp_replace(s, "[1-5]$", ""), F.lit("u:"), F.lit("ü")), F.lit("U:"), F.lit("Ü"))
    patterns = ["^(.*?)([aA])(.*)$", "^(.*?)([eE])(.*)$", "^(.*?)([oO])([uU].*)$", "^(.*)([iouüIOUÜ])([^iouüIOUÜ]*)$"]
    out = base
    for p in reversed(patterns):
        marked = F.regexp_extract(base, p, 2)
        for k, row in enumerate(TONES, 1):
            marked = F.when(tone == str(k), F.translate(F.regexp_extract(base, p, 2), VOWELS, row)).otherwise(marked)
        out = F.when(base.rlike(p), F.concat(F.regexp_extract(base, p, 1), marked, F.regexp_extract(base, p, 3))).otherwise(out)
    return out


def pinyin(s: Column) -> Column:
    return F.array_join(F.transform(F.split(s, " "), pinyin_syllable), " ")
