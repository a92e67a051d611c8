"""Text expressions. All are built-in functions, so they stay in the JVM; lengths and positions
count code points. The exceptions are ``html_text_parsed``, for markup beyond regular expressions,
and ``bucket_counts``, as no built-in counts the elements of an array."""

from __future__ import annotations

import hashlib
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Python's str.strip and \s take for white space, as a Java character class.
_BLANK = r"[\s\x1c-\x1f]"
#: MIME types by file ending, all others being plain text.
MIME_BY_ENDING = {".pdf": "application/pdf", ".md": "text/markdown", ".html": "text/html"}
PLAIN_TEXT = "text/plain"
SUPPORTED_MIME = ("application/pdf", "text/plain", "text/markdown", "text/html")
#: Separators of fixed-size chunks, by priority.
SEPARATORS = ("\n\n", "\n", ". ", " ")
#: Patterns of what is cut from pages, or put in its place.
SCRIPTS = r"(?is)<(script|style)[^>]*>.*?</\1>"
IMAGE_WITH_TEXT = r"""(?i)<img[^>]*?alt=["']([^>\n]*?)["'][^>]*>"""
IMAGE = r"(?i)<img[^>]*>"
#: Name spaces of chunk ids and of stored texts.
CHUNK_NAMESPACE = "37000000-0000-0000-0000-000000000037"
DNS_NAMESPACE = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"
SPARSE_BUCKETS = 10000
#: Values that a fold collects in one array before it begins another.
FOLD = 256


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)^{_BLANK}+|{_BLANK}+$", "")


def sanitize(text: Column) -> Column:
    """Without NUL, with \\n line ends, stripped."""
    return strip(F.regexp_replace(F.replace(text, F.lit("\0"), F.lit("")), r"\r\n?", "\n"))


def decode(content: Column) -> Column:
    """UTF-8, or Latin-1 when the bytes are not valid UTF-8."""
    text = content.cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(F.decode(content, "ISO-8859-1"))


def ending(path: Column) -> Column:
    """The lower-cased file ending with its dot, empty without one."""
    return F.lower(F.regexp_extract(path, r"([^/.])(\.[^./]*)$", 2))


def mime_of(path: Column) -> Column:
    end, out = ending(path), F.lit(PLAIN_TEXT)
    for suffix, mime in MIME_BY_ENDING.items():
        out = F.when(end == suffix, mime).otherwise(out)
    return out


def _marked_images(html: Column) -> Column:
    """Without scripts and styles, images as their alternative text."""
    x = F.regexp_replace(html, SCRIPTS, "")
    return F.regexp_replace(F.regexp_replace(x, IMAGE_WITH_TEXT, "[Image: $1]"), IMAGE, "[Image]")


def html_text(html: Column) -> Column:
    """Character data of simple markup, white space collapsed; images become their alt text.

    All in the JVM, for pages known to be simple: named entities beyond the common ones, numeric
    ones and malformed markup need ``html_text_parsed``, which ingestion uses.
    """
    x = F.regexp_replace(_marked_images(html), r"(?s)<!--.*?-->", "")
    x = F.regexp_replace(x, r"<[!/]?[a-zA-Z][^>]*>", "")
    for name, char in (("copy", "©"), ("middot", "·"), ("nbsp", " "), ("quot", '"'), ("#39", "'"), ("lt", "<"), ("gt", ">"), ("amp", "&")):
        x = F.regexp_replace(x, f"&{name};", char)
    return sanitize(F.regexp_replace(x, rf"(?U){_BLANK}+", " "))


class _CharacterData(HTMLParser):
    def __init__(self):
        super().__init__()
        self.parts: list[str] = []

    def handle_data(self, data):
        self.parts.append(data)


def _character_data(pages: pd.Series) -> pd.Series:
    def read(page):
        if page is None:
            return None
        parser = _CharacterData()
        parser.feed(page)
        return "".join(parser.parts)

    return pages.map(read)


def html_text_parsed(html: Column) -> Column:
    """As ``html_text``, with a real parser for any markup and entity (an Arrow UDF)."""
    return sanitize(F.regexp_replace(F.pandas_udf(_character_data, "string")(_marked_images(html)), rf"(?U){_BLANK}+", " "))


def extract(content: Column, mime: Column) -> Column:
    """Text of a file's bytes; null for a MIME type that is not supported.

    PDF is empty here: its text needs a reader that is plugged in (``ingest.extracted``). Only the
    pages among the files travel to the parser.
    """
    text = decode(content)
    return (
        F.when(mime == "text/html", html_text_parsed(F.when(mime == "text/html", text))).when(mime.isin("text/plain", "text/markdown"), sanitize(text))
        .when(mime == "application/pdf", F.lit(""))
    )


def tokens(text: Column) -> Column:
    """Lower-cased words of letters, digits and underscores in any script."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def hash_bucket(word: Column, buckets: int = SPARSE_BUCKETS) -> Column:
    """SHA-256 of a word, as one number, modulo ``buckets``: Horner over its hexadecimal digits, 15 at a time."""
    digest = F.sha2(word.cast("binary"), 256)
    acc = F.lit(0).cast("long")
    if (1 << 60) % buckets == 0:
        return (F.conv(F.substring(digest, 50, 15), 16, 10).cast("long") % buckets).cast("int")
    for begin in range(0, 64, 15):
        n = min(15, 64 - begin)
        acc = (acc * (16**n % buckets) + F.conv(F.substring(digest, begin + 1, n), 16, 10).cast("long")) % buckets
    return acc.cast("int")


@lru_cache(1 << 16)
def _bucket(word: str, buckets: int) -> int:
    return int.from_bytes(hashlib.sha256(word.encode()).digest(), "big") % buckets


def bucket_counts(words: Column, buckets: int = SPARSE_BUCKETS) -> Column:
    """array<struct<bucket, n>> of a text's words by ``hash_bucket``, sorted (an Arrow UDF): a row's words are counted where they are."""

    def count(lists: pa.Array) -> pa.Array:
        coded = pc.dictionary_encode(lists.flatten().drop_null())
        bucket = np.array([_bucket(w, buckets) for w in coded.dictionary.to_pylist()], np.int64)
        row = pc.list_parent_indices(lists).to_numpy().astype(np.int64)
        pairs, n = np.unique(row * buckets + bucket[coded.indices.to_numpy()], return_counts=True)
        ends = np.searchsorted(pairs, np.arange(len(lists) + 1, dtype=np.int64) * buckets).astype(np.int32)
        told = pa.StructArray.from_arrays([pa.array((pairs % buckets).astype(np.int32)), pa.array(n.astype(np.int64))], ["bucket", "n"])
        return pa.ListArray.from_arrays(pa.array(ends), told)

    return F.arrow_udf(count, "array<struct<bucket:int,n:long>>")(words)


def uuid5(namespace: str, name: Column) -> Column:
    """Name-based UUID, version 5."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), name.cast("binary")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1), F.lit(1))
    return F.concat(
        F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12)
    )


def chunk_id(path: Column, index: Column) -> Column:
    return uuid5(CHUNK_NAMESPACE, F.concat(path, F.lit("_"), index.cast("string")))


def store_id(collection: Column, text: Column) -> Column:
    return uuid5(DNS_NAMESPACE, F.concat(collection, F.lit(":"), text))


def _check(size: int, overlap: int) -> None:
    if overlap >= size:
        raise ValueError(f"chunk_overlap ({overlap}) must be less than chunk_size ({size})")
    if overlap < 0:
        raise ValueError("chunk_overlap must not be negative: hard cuts would skip text")


def _not_empty(pieces: Column) -> Column:
    return F.filter(pieces, lambda p: p != "")


def once(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def folded(items: Column, state: Column, step, kind: str) -> Column:
    """struct<state, out>: a fold that puts out values, in work proportional to its items.

    ``step`` of state and item is a struct ``state, put``, put being an array<kind>. Appending to
    an array copies it, so ``FOLD`` items fill an array of their own.
    """
    nothing, nested = F.array().cast(f"array<{kind}>"), F.array().cast(f"array<array<{kind}>>")

    def append(acc, x):
        return once(step(acc["state"], x), lambda r: F.struct(r["state"].alias("state"), F.concat(acc["out"], r["put"]).alias("out")))

    def block(acc, b):
        inner = F.aggregate(b, F.struct(acc["state"].alias("state"), nothing.alias("out")), append)
        return once(inner, lambda r: F.struct(r["state"].alias("state"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

    def all_blocks(every):
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(every) - 1) / FOLD).cast("int")), lambda i: F.slice(every, i * FOLD + 1, F.lit(FOLD)))
        done = F.aggregate(blocks, F.struct(state.alias("state"), nested.alias("out")), block)
        return once(done, lambda r: F.struct(r["state"].alias("state"), F.flatten(r["out"]).alias("out")))

    return once(items, lambda every: F.when(F.size(every) == 0, F.struct(state.alias("state"), nothing.alias("out"))).otherwise(all_blocks(every)))


def _pages(text: Column, size: int) -> Column:
    """A text in pieces of ``size`` code points, in which places are found without reading from its beginning."""
    return F.when(F.length(text) <= size, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(f"(?s)(.{{1,{size}}})"), F.lit(1)))


def _part(pages: Column, page: int, start: Column, length: Column) -> Column:
    """``length`` code points, at most a page, from ``start`` on."""
    n = F.floor(start / page).cast("int")
    here = F.get(pages, n)
    both = F.when(start % page + length <= F.length(here), here).otherwise(F.concat(here, F.coalesce(F.get(pages, n + 1), F.lit(""))))
    return F.substring(both, start % page + 1, length)


def _cut_pieces(text: Column, size: int, overlap: int) -> Column:
    """The pieces of a text longer than ``size``, by a fold over at most as many steps."""
    page = max(256, 2 * size)

    def pieces(bound):
        pages, n = bound["pages"], bound["n"]

        def step(at, _):
            end = at + size

            def after_separator(window):
                places = [F.instr(window, F.lit(sep[::-1])) for sep in SEPARATORS]
                return F.coalesce(*(F.when(place > 0, end - place + 1) for place in places))

            cut = once(F.reverse(_part(pages, page, end - overlap, F.lit(overlap))), after_separator)

            def put(c):
                to = F.coalesce(c, end)
                return F.struct(F.coalesce(c, end - overlap).alias("state"), F.array(strip(_part(pages, page, at, to - at))).alias("put"))

            done = F.struct(at.alias("state"), F.array().cast("array<string>").alias("put"))
            return F.when(at >= n, done).otherwise(once(F.when(end >= n, n).otherwise(cut), put))

        return folded(F.sequence(F.lit(1), F.ceil(n / (size - overlap)).cast("int") + 1), F.lit(0), step, "string")["out"]

    return once(F.struct(_pages(text, page).alias("pages"), F.length(text).alias("n")), pieces)


def chunk_fixed(text: Column, size: int = 500, overlap: int = 50) -> Column:
    """Pieces of at most ``size`` code points, cut after the last separator in the look-back window.

    Only a hard cut, where the window holds no separator, overlaps the next piece. A text that
    fits is one piece as it is; pieces of longer texts are stripped, and empty ones dropped. The
    work is in proportion to the text.
    """
    _check(size, overlap)
    none = F.array().cast("array<string>")
    return F.when(text.isNull() | (text == ""), none).when(F.length(text) <= size, F.array(text)).otherwise(_not_empty(_cut_pieces(text, size, overlap)))


def _fitted(pieces: Column, size: int, overlap: int) -> Column:
    """Pieces within size as they are, others cut to fixed size; no empty ones."""
    return _not_empty(F.flatten(F.transform(pieces, lambda p: chunk_fixed(p, size, overlap))))


def chunk_markdown(text: Column, size: int = 500, overlap: int = 50) -> Column:
    """Sections that begin at heading lines, stripped; those too long are cut to fixed size."""
    _check(size, overlap)
    sections = F.transform(F.split(text, r"(?U)\n(?=[^\S\n]*#{1,6} [^\n]*\S)", -1), strip)
    none = F.array().cast("array<string>")
    return F.when(text.isNull() | (text == ""), none).otherwise(_fitted(sections, size, overlap))


def sentences(text: Column) -> Column:
    return _not_empty(F.transform(F.split(text, rf"(?U)(?<=[.!?]){_BLANK}+", -1), strip))


def chunk_semantic(parts: Column, vectors: Column, distance, threshold: float = 0.5, size: int = 500, overlap: int = 50) -> Column:
    """Runs of sentences: a new one where neighbours' distance passes the threshold or it is full.

    ``parts`` are a text's sentences, ``vectors`` one vector each, ``distance`` a function of two
    vector columns.
    """
    _check(size, overlap)

    def step(now, x):
        close = x["far"] | (F.length(now) + F.length(x["part"]) + 1 > size)
        put = F.when(close, F.array(now)).otherwise(F.array().cast("array<string>"))
        return F.struct(F.when(close, x["part"]).otherwise(F.concat(now, F.lit(" "), x["part"])).alias("state"), put.alias("put"))

    def runs(p):
        later = F.transform(F.slice(p, F.lit(2), F.size(p)), lambda part, i: F.struct(part.alias("part"), (distance(F.get(vectors, i), F.get(vectors, i + 1)) > threshold).alias("far")))
        return once(folded(later, F.element_at(p, 1), step, "string"), lambda r: F.concat(r["out"], F.array(r["state"])))

    none = F.array().cast("array<string>")
    whole = F.when(F.size(parts) <= 1, parts).otherwise(once(parts, runs))
    return F.when(parts.isNull() | (F.size(parts) == 0), none).otherwise(_fitted(whole, size, overlap))


def preview(text: Column, size: int = 60) -> Column:
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def vocab_id(word: Column, date: Column) -> Column:
    """vocab_<word without article, other characters as _>_<yymmdd>."""
    bare = F.regexp_replace(F.lower(word), r"^(der|die|das|den|dem|des) ", "")
    clean = F.regexp_replace(F.regexp_replace(bare, r"[^\p{L}\p{N}]", "_"), r"^_+|_+$", "")
    return F.concat(F.lit("vocab_"), clean, F.lit("_"), F.date_format(date, "yyMMdd"))


def format_bytes(n: Column, units: tuple[str, ...] = ("Bytes", "KB", "MB", "GB"), decimals: int = 2) -> Column:
    """A size with its binary unit, as JavaScript prints the number."""
    power = F.lit(0)
    for i in range(1, len(units)):
        power = F.when(n >= 1024**i, i).otherwise(power)
    value = F.round(n / F.pow(F.lit(1024.0), power), decimals)
    shown = F.regexp_replace(F.format_string(f"%.{decimals}f", value), r"\.?0+$", "") if decimals else F.format_string("%.0f", value)
    return F.when(n == 0, f"0 {units[0]}").otherwise(F.concat(shown, F.lit(" "), F.element_at(F.array(*map(F.lit, units)), power + 1)))


def model_name(name: Column) -> Column:
    """Without the first provider prefix."""
    return F.regexp_replace(name, r"^(?i)(google|gemini|openai|anthropic|ollama):", "")


def render(template: Column, values: dict[str, Column], style: str = "braces") -> Column:
    """Fill {name} or, with style "dollar", $name and ${name}; what is unknown stays."""
    if style not in ("braces", "dollar"):
        raise ValueError(f"unsupported style {style}")
    out = template
    if style == "braces":
        for key, value in values.items():
            out = F.replace(out, F.lit(f"{{{key}}}"), value)
        return out
    dollar, here = "", ""  # stand-ins for an escaped dollar and for a value's place
    out = F.replace(out, F.lit("$$"), F.lit(dollar))
    for key, value in values.items():
        out = F.replace(F.regexp_replace(out, rf"\$(?:\{{{key}\}}|{key}(?![A-Za-z0-9_]))", here), F.lit(here), value)
    return F.replace(out, F.lit(dollar), F.lit("$"))
