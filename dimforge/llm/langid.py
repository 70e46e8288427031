"""Languages of documents and of their pieces, by compression.

A language is a zstandard raw-content dictionary of its prose. A text is encoded with every
dictionary, and the one that makes it smallest names the language, unless the margin to the next is
narrow: such text has no language. Dictionaries are made from a bounded sample of labelled documents;
labels of the sample may be wrong, so a sentence goes into a dictionary only if its words are more
usual under its label than under any other.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dimforge.functions.names import col, require
from dimforge.llm import prose

# ISO 639 codes and English names of languages with large text corpora.
LANGUAGES = {
    "ar": ("ara", "arabic"), "bg": ("bul", "bulgarian"), "ca": ("cat", "catalan"), "cs": ("ces", "cze", "czech"), "da": ("dan", "danish"), "de": ("deu", "ger", "german"),
    "el": ("ell", "gre", "greek"), "en": ("eng", "english"), "es": ("spa", "spanish", "castilian"), "et": ("est", "estonian"), "fa": ("fas", "per", "persian"), "fi": ("fin", "finnish"),
    "fr": ("fra", "fre", "french"), "he": ("heb", "hebrew"), "hi": ("hin", "hindi"), "hr": ("hrv", "croatian"), "hu": ("hun", "hungarian"), "id": ("ind", "indonesian"),
    "it": ("ita", "italian"), "ja": ("jpn", "japanese"), "ko": ("kor", "korean"), "lt": ("lit", "lithuanian"), "lv": ("lav", "latvian"), "nl": ("nld", "dut", "dutch", "flemish"),
    "no": ("nor", "nb", "nn", "nob", "nno", "norwegian"), "pl": ("pol", "polish"), "pt": ("por", "portuguese"), "ro": ("ron", "rum", "romanian"), "ru": ("rus", "russian"),
    "sk": ("slk", "slo", "slovak"), "sl": ("slv", "slovenian", "slovene"), "sr": ("srp", "serbian"), "sv": ("swe", "swedish"), "th": ("tha", "thai"), "tr": ("tur", "turkish"),
    "uk": ("ukr", "ukrainian"), "vi": ("vie", "vietnamese"), "zh": ("zho", "chi", "chinese"),
}
_CODES = {x: k for k, v in LANGUAGES.items() for x in (k, *v)}

#: How texts are encoded: matches of four bytes or more, found through one table, letters that match nothing left as they are (a
#: target length above 0 says so). Entropy coding would take half the time and tell the languages no better.
ENCODING = {"window_log": 17, "chain_log": 6, "hash_log": 14, "search_log": 1, "min_match": 4, "target_length": 1, "strategy": 1}
#: Texts whose sentences go through a dictionary together; it bounds memory and changes no result.
TOGETHER = 64
#: A text counts as recognised if the best dictionary saves at least this share over the next one.
SENTENCE_MARGIN = 0.12


def label_code(c: Column) -> Column:
    """Two-letter code that a label means: a code of two or three letters, a region variant or an English name; else null."""
    base = F.regexp_extract(F.lower(F.trim(c)), r"^([a-z]+)(?:[-_][a-z0-9]+)*$", 1)
    table = F.create_map(*[F.lit(x) for kv in sorted(_CODES.items()) for x in kv])
    return table[base]


class Model:
    """Dictionaries by language, as bytes; compressors are made once per process."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.dictionaries = dict(sorted(dictionaries.items()))

    @property
    def languages(self) -> list[str]:
        return list(self.dictionaries)

    def sizes(self, texts: list[bytes]) -> list[list[int]]:
        """Of each language in order, the encoded size of every text, beyond the frame's fixed bytes.

        All texts go through one dictionary before the next: its tables stay in the processor's cache.
        """
        return [[max(1, len(x) - 9) for x in c.multi_compress_to_buffer(texts)] for c in _compressors(tuple(self.dictionaries.items()))] if texts else [[] for _ in self.dictionaries]

    def best(self, texts: list[bytes]) -> list[tuple[str | None, float]]:
        """(language, margin) of each text: the dictionary that makes it smallest, and the share it saves over the next.

        With one dictionary only, the next is none at all.
        """
        names = self.languages
        if not names:
            return [(None, 0.0)] * len(texts)
        out = []
        for text, sizes in zip(texts, zip(*self.sizes(texts))):
            least = min(sizes)
            k = sizes.index(least)
            second = min(sizes[:k] + sizes[k + 1 :]) if len(sizes) > 1 else max(1, len(text))
            out.append((names[k], 1 - least / second))
        return out


@lru_cache(maxsize=4)
def _compressors(items: tuple[tuple[str, bytes], ...]) -> list:
    import zstandard  # only here, so that the other operators on texts don't need it

    params = zstandard.ZstdCompressionParameters(write_content_size=False, write_checksum=False, write_dict_id=False, **ENCODING)
    out = []
    for _, data in items:
        d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=params)
        out.append(zstandard.ZstdCompressor(dict_data=d, compression_params=params))
    return out


def encoded(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace")


def fit(documents: DataFrame, *, doc_id: str, text: str, label: str, per_language: int = 300, sentences_each: int = 12, dictionary_bytes: int = 48_000, least_sentences: int = 8, sentence_chars: int = 400) -> Model:
    """A model from at most `per_language` labelled documents of each language and `sentences_each` sentences of each.

    The sentences are spread evenly over a text, and of each at most `sentence_chars` characters are
    taken, so that a text without full stops can't swamp the driver or fill a dictionary. The documents are those with the smallest hash of their id, so the sample is the same for every
    layout of the table; what reaches the driver is bounded by these numbers. Languages with fewer than
    `least_sentences` usable sentences have no dictionary.
    """
    require(documents, doc_id, text, label)
    code = label_code(col(label))
    rows = documents.where(col(text).isNotNull()).select(col(doc_id).alias("id"), code.alias("lang")).where("lang is not null")
    w = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    chosen = rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= per_language).select("id", "lang")
    # A sample of bounded size: broadcasting its ids keeps the texts where they are.
    texts = documents.select(col(doc_id).alias("id"), col(text).alias("text")).join(F.broadcast(chosen), "id")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, got = [], []
            for lang, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = [s for p in prose.pieces(t) for s in prose.sentences(p)]
                for s in spread_over(found, sentences_each):
                    langs.append(lang)
                    got.append(s[:sentence_chars])
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(got, pa.string())], names=["lang", "s"])

    by: dict[str, list[str]] = defaultdict(list)
    for r in sorted(texts.select("lang", "text").mapInArrow(work, "lang string, s string").collect(), key=lambda r: (r[0], r[1])):
        by[r[0]].append(r[1])
    return Model(dictionaries_of(by, dictionary_bytes, least_sentences))


def spread_over(items: list[str], n: int) -> list[str]:
    """At most `n` of `items`, evenly spread over all of them."""
    n = min(n, len(items))
    return [items[i * len(items) // n] for i in range(n)]


def dictionaries_of(by: dict[str, list[str]], dictionary_bytes: int, least_sentences: int) -> dict[str, bytes]:
    """Raw-content dictionaries from labelled sentences, some of which are labelled wrong."""
    words = {k: Counter(w for s in v for w in set(_words(s))) for k, v in by.items()}
    share = {k: {w: n / max(1, len(by[k])) for w, n in c.items()} for k, c in words.items()}
    out = {}
    for k, v in by.items():
        kept = []
        for s in dict.fromkeys(v):
            ws = _words(s)
            score = {j: sum(math.log(share[j].get(w, 0) + 1e-3) for w in ws) for j in by}
            if max(score, key=lambda j: (score[j], j)) == k:
                kept.append(s)
        if len(kept) < least_sentences:
            continue
        known: set[str] = set()
        first, rest = [], []
        for s in kept:  # sentences with new words have precedence
            new = set(_words(s)) - known
            (first if new else rest).append(s)
            known |= new
        size, content = 0, []
        for s in [*first, *rest]:
            b = encoded(s) + b"\n"
            if size + len(b) > dictionary_bytes:
                break
            size += len(b)
            content.append(b)
        out[k] = b"".join(reversed(content))  # near content is cheapest to refer to
    return out


_WORD = re.compile(rf"[{prose.HAN}{prose.THAI}]|[^\W\d_]+")


def _words(s: str) -> list[str]:
    """Words of `s`; in scripts without blanks between words, letters."""
    return _WORD.findall(s.lower())


def judge(texts: list[str | None], model: Model, margin: float = SENTENCE_MARGIN) -> list[list[tuple[int, str, float]]]:
    """Of each text its (segment, language, confidence): segment 0 the text, k its k-th piece where that has prose.

    The text's language is that of most of its prose, in characters, and so is a piece's. Every sentence
    is tried with every dictionary; a piece without a recognised sentence is tried whole, and prose that
    no dictionary recognises belongs to no language. Confidence is the share of prose in that language
    times the margin by which its dictionary wins. No prose: no rows. Each text is judged by itself.
    """
    found = [[(k, ss) for k, p in enumerate(prose.pieces(t), 1) if (ss := prose.sentences(p))] if t is not None else [] for t in texts]
    guesses = iter(model.best([encoded(s) for pieces in found for _, ss in pieces for s in ss]))
    judged, whole = [], []
    for pieces in found:
        own = []
        for k, ss in pieces:
            chars: Counter = Counter()
            margins = []
            for s in ss:
                lang, m = next(guesses)
                if lang is not None and m >= margin:
                    chars[lang] += len(s)
                    margins.append(m)
            own.append([k, ss, chars, margins])
            if not chars and len(ss) > 1:
                whole.append(own[-1])
        judged.append(own)
    for piece, (lang, m) in zip(whole, model.best([encoded("\n".join(p[1])) for p in whole])):
        if lang is not None and m >= margin:
            piece[2][lang] = sum(map(len, piece[1]))
            piece[3].append(m)
    return [_verdict(own) for own in judged]


def _verdict(pieces: list) -> list[tuple[int, str, float]]:
    """The rows of one text from its pieces: number, sentences, characters by language, margins."""
    lead = lambda c: min(c, key=lambda x: (-c[x], x))
    sure = [(k, chars, sum(margins) / len(margins)) for k, _, chars, margins in pieces if chars]
    if not sure:
        return []
    total: Counter = Counter()
    for _, chars, _ in sure:
        total.update(chars)
    main = lead(total)
    out = [(0, main, total[main] / sum(total.values()) * max(s for _, _, s in sure))]
    return out + [(k, (own := lead(chars)), chars[own] / sum(chars.values()) * s) for k, chars, s in sure]


def _judged(source: DataFrame, model: Model) -> DataFrame:
    """Of columns doc and text: doc, segment_no, lang, confidence and main, the language of the whole text."""
    schema = source.select("doc").schema.add("segment_no", "integer").add("lang", "string").add("confidence", "double").add("main", "string")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows = [], []
            for start in range(0, len(b), TOGETHER):
                for i, got in enumerate(judge([t.as_py() for t in b.column(1)[start : start + TOGETHER]], model), start):
                    at += [i] * len(got)
                    rows += [(*r, got[0][1]) for r in got]
            cols = [pa.array([r[j] for r in rows], kind) for j, kind in enumerate((pa.int32(), pa.string(), pa.float64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *cols], names=["doc", "segment_no", "lang", "confidence", "main"])

    return source.mapInArrow(work, schema)


def identify(documents: DataFrame, model: Model, *, doc_id: str, text: str) -> DataFrame:
    """`doc_id`, `segment_no`, `lang`, `confidence` of every document with prose and each of its pieces with prose.

    Whole texts are read, in one pass over the table without a shuffle; other columns aren't touched.
    Documents without a sentence of prose, and null or blank ones, have no rows.
    """
    require(documents, doc_id, text)
    got = _judged(documents.select(col(doc_id).alias("doc"), col(text).alias("text")), model)
    return got.select(F.col("doc").alias("doc_id"), "segment_no", "lang", "confidence")


def mislabelled(documents: DataFrame, model: Model, *, doc_id: str, text: str, label: str) -> DataFrame:
    """Rows of :func:`identify` to be set right: segment 0 where the label names no language or another,
    and pieces in another language than their text."""
    require(documents, doc_id, text, label)
    source = documents.select(F.struct(col(doc_id).alias("id"), col(label).alias("label")).alias("doc"), col(text).alias("text"))
    got = _judged(source, model)
    case = F.when(F.col("segment_no") == 0, ~label_code(F.col("doc.label")).eqNullSafe(F.col("lang"))).otherwise(F.col("lang") != F.col("main"))
    return got.where(case).select(F.col("doc.id").alias("doc_id"), "segment_no", "lang", "confidence")
