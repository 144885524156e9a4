"""Quality rules: distribution divergence from language references.

A document's histogram of character classes and its histogram of common words are compared, by Jensen-Shannon distance, to
fixed references of several languages; the nearest language counts. A histogram is judged only when it has enough
observations (the minimum-length guards), because short texts diverge by chance.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import SPACE, byte_set, find_words, flat, hash_spans, id_text, lower_ascii, map_text, mix, session, slices, window_hashes

#: Shares of character classes in running prose, in the order of CLASSES.
CLASSES = ("lower", "upper", "non_ascii", "digit", "space", "punctuation", "symbol")
CHAR_REFERENCE = {
    "en": (0.780, 0.020, 0.002, 0.005, 0.165, 0.026, 0.002),
    "de": (0.770, 0.045, 0.018, 0.005, 0.135, 0.025, 0.002),
    "fr": (0.750, 0.020, 0.045, 0.005, 0.150, 0.028, 0.002),
    "es": (0.770, 0.020, 0.025, 0.005, 0.155, 0.023, 0.002),
}
#: Shares of the commonest words among all words; what is missing from 1 is every other word.
WORD_REFERENCE = {
    "en": {"the": 0.062, "of": 0.032, "and": 0.028, "to": 0.026, "a": 0.022, "in": 0.020, "is": 0.011, "that": 0.011, "for": 0.009, "it": 0.009, "was": 0.008, "with": 0.007, "on": 0.007, "are": 0.006, "as": 0.006, "be": 0.006, "this": 0.005, "by": 0.005, "at": 0.004, "from": 0.004},
    "de": {"der": 0.034, "die": 0.034, "und": 0.028, "in": 0.018, "den": 0.012, "von": 0.010, "zu": 0.010, "das": 0.010, "mit": 0.008, "sich": 0.007, "des": 0.007, "auf": 0.007, "für": 0.007, "ist": 0.007, "im": 0.007, "dem": 0.007, "nicht": 0.006, "ein": 0.006, "eine": 0.006, "als": 0.005},
    "fr": {"de": 0.045, "la": 0.028, "le": 0.024, "et": 0.021, "les": 0.021, "des": 0.019, "en": 0.014, "un": 0.012, "du": 0.012, "une": 0.011, "que": 0.010, "est": 0.010, "dans": 0.009, "qui": 0.008, "par": 0.007, "pour": 0.007, "au": 0.006, "pas": 0.005, "avec": 0.004, "ou": 0.003},
    "es": {"de": 0.060, "la": 0.038, "que": 0.030, "el": 0.029, "en": 0.026, "y": 0.025, "a": 0.020, "los": 0.017, "se": 0.012, "del": 0.012, "las": 0.011, "un": 0.010, "por": 0.010, "con": 0.009, "no": 0.009, "una": 0.009, "para": 0.007, "es": 0.007, "al": 0.006, "lo": 0.006},
}
#: Guards: fewer characters or words than these leave a histogram unjudged.
MIN_CHARS, MIN_WORDS = 300, 50
#: Jensen-Shannon distances (base 2, 0 to 1) above these fail. Clean prose lies far below, also where its vocabulary is odd.
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.20, 0.45
#: A text without any common word lies at 0.36 to 0.45 of a language, so within MAX_WORD_DISTANCE of some. As a share of that
#: distance, the nearest language has to be below this. A text in a language without a reference isn't judged by its words: it is
#: told by distinct words, which in prose are so many times the root of all words at least, at any length.
MAX_WORD_SHARE, FOREIGN_ROOT = 0.98, 4
#: Base rules of the contract.
MIN_BASE_WORDS, REPEAT_WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30

_PUNCTUATION = b".,;:!?'\"()-"
_SYMBOLS = byte_set(b"#*$%&|<>")

_class_of = np.full(256, 6, np.int64)
_class_of[97:123], _class_of[65:91], _class_of[48:58], _class_of[192:] = 0, 1, 3, 2
_class_of[128:192] = 7  # a continuation byte, no character of its own
_class_of[SPACE] = 4
_class_of[byte_set(_PUNCTUATION)] = 5
_NO_LETTER = np.ones(256, bool)
_NO_LETTER[65:91] = _NO_LETTER[97:123] = _NO_LETTER[128:] = False

_FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, char_distance double, word_distance double, base_failed boolean, kept boolean"


def _hash_words(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(w) for w in raw])
    return hash_spans(np.frombuffer(b"".join(raw), np.uint8), ends - [len(w) for w in raw], ends)


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance, base 2, of each row of counts p from the distribution q; 0 for a row without counts."""
    total = p.sum(1, keepdims=True)
    p = p / np.maximum(total, 1)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0).sum(1)
        b = np.where(q > 0, q * np.log2(q / m), 0).sum(1)
    return np.where(total[:, 0] > 0, np.sqrt(np.maximum((a + b) / 2, 0)), 0)


def _count(rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, minlength=n).astype(np.int64)


def _repeat_words(h: np.ndarray, first: np.ndarray, n: int, size: int) -> np.ndarray:
    """Words in windows of `size` words that occur twice or more in their row. first: each row's first word, one more at the end."""
    w = window_hashes(h, size)
    if not len(w):
        return np.zeros(n, np.int64)
    row = np.repeat(np.arange(n), np.diff(first))
    whole = row[: len(w)] == row[size - 1 :]
    at = np.flatnonzero(whole)
    with np.errstate(over="ignore"):
        key = w[at] + mix(row[at].astype(np.uint64))  # equal windows of different rows differ
    by_key = np.argsort(key)
    order, key = at[by_key], key[by_key]
    same = key[1:] == key[:-1]
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    cover = np.zeros(len(h) + 1, np.int64)
    np.add.at(cover, order[twice], 1)
    np.add.at(cover, order[twice] + size, -1)
    return _count(row[np.cumsum(cover[:-1]) > 0], n)


def _distinct(h: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """How many different hashes each row has."""
    order = np.lexsort((h, rows))
    h, rows = h[order], rows[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])]) if len(h) else np.zeros(0, bool)
    return _count(rows[new], n)


def measure(data: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """The fields of `quality_of`, in order, for the texts data[offs[i]:offs[i + 1]]."""
    n = len(offs) - 1
    row = np.repeat(np.arange(n), np.diff(offs))
    a, b, r = find_words(data, offs)
    n_words = _count(r, n)
    first = np.concatenate([[0], np.cumsum(n_words)])
    classes = np.bincount(row * 8 + _class_of[data], minlength=8 * n).reshape(n, 8)[:, :7]
    word_chars = classes.sum(1) - classes[:, 4]
    n_symbols = _count(row[_SYMBOLS[data]], n)
    repeats = _repeat_words(hash_spans(data, a, b), first, n, REPEAT_WINDOW)

    raw = data.tobytes()
    dup = np.zeros(n, np.int64)
    for i in range(n):
        lines = [x for x in raw[offs[i] : offs[i + 1]].split(b"\n") if x and not x.isspace()]
        dup[i] = len(lines) - len(set(lines))

    char = np.min([distance(classes, np.array(q) / sum(q)) for q in CHAR_REFERENCE.values()], axis=0)
    low = lower_ascii(data)
    a, b, r = find_words(low, offs, _NO_LETTER)
    h, letters = hash_spans(low, a, b), _count(r, n)
    far, share = [], []
    for q in WORD_REFERENCE.values():
        keys = _hash_words(list(q))
        order = np.argsort(keys)
        at = np.minimum(np.searchsorted(keys[order], h), len(keys) - 1)
        which = np.where(keys[order][at] == h, order[at], len(keys))
        seen = np.bincount(r * (len(keys) + 1) + which, minlength=n * (len(keys) + 1)).reshape(n, len(keys) + 1)
        ref = np.array([*q.values(), 1 - sum(q.values())])
        far.append(distance(seen, ref))
        share.append(far[-1] / distance(np.eye(len(ref))[-1:], ref))
    word = np.min(far, axis=0)
    strange = (np.min(share, axis=0) > MAX_WORD_SHARE) & (_distinct(h, r, n) ** 2 < FOREIGN_ROOT**2 * letters)
    foreign = (word > MAX_WORD_DISTANCE) | strange

    failed = (n_words < MIN_BASE_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * n_words)
    diverges = (classes.sum(1) >= MIN_CHARS) & (char > MAX_CHAR_DISTANCE) | (letters >= MIN_WORDS) & foreign
    return [n_words, word_chars, n_symbols, dup, repeats, char, word, failed, ~failed & ~diverges]


def quality_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the base counts, char_distance, word_distance, base_failed, kept: one row for each row of docs.

    A null or empty text has no words, so it fails the base rules. Null and repeated doc_ids keep their rows. An empty table
    gives no rows. Other columns are not read. Nothing is shuffled.
    """

    def fn(ids: pa.Array, data: np.ndarray, offs: np.ndarray) -> pa.RecordBatch:
        fields = measure(data, offs)
        return pa.RecordBatch.from_arrays([ids, *map(pa.array, fields)], names=["doc_id", *(x.split()[0] for x in _FIELDS.split(", "))])

    return map_text(id_text(docs, id_col, text_col), fn, f"doc_id long, {_FIELDS}")


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose text passes; row by row, so clashing names and repeated ids don't matter."""

    def run(batches):
        for batch in batches:
            text = batch.column(batch.schema.get_field_index(text_col))
            data, offs = flat(text)
            ok = [np.zeros(0, bool)]
            for a, b in slices(offs):
                o = offs[a : b + 1]
                ok.append(measure(data[o[0] : o[-1]], o - o[0])[-1])
            yield batch.filter(pa.array(np.concatenate(ok)))

    session(docs)
    return docs.mapInArrow(run, docs.schema)


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    out = quality_of(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _oracle() -> str:
    values = lambda rows: ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else repr(float(x)) for x in r) + ")" for r in rows)
    lower = "translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    sets = {"lower": "[^a-z]", "upper": "[^A-Z]", "non_ascii": r"[\x00-\x7F]", "digit": "[^0-9]", "space": r"[^\x20\x09-\x0D]", "punctuation": r"""[^.,;:!?''"()-]"""}
    counts = " UNION ALL ".join(f"SELECT r, '{k}' AS c, length(regexp_replace(t, '{v}', '', 'g')) AS n FROM d" for k, v in sets.items())
    chars = [(lang, c, x / sum(q)) for lang, q in CHAR_REFERENCE.items() for c, x in zip(CLASSES, q, strict=True)]
    words = [(lang, w, x) for lang, q in WORD_REFERENCE.items() for w, x in q.items()]
    rest = [(lang, 1 - sum(q.values())) for lang, q in WORD_REFERENCE.items()]
    alone = [(lang, float(distance(np.eye(len(q) + 1)[-1:], np.array([*q.values(), 1 - sum(q.values())]))[0])) for lang, q in WORD_REFERENCE.items()]
    half = "CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, i, list_slice(w, i, i + {REPEAT_WINDOW - 1}) AS s FROM (SELECT r, w, unnest(range(1, len(w) - {REPEAT_WINDOW - 2})) AS i FROM d WHERE len(w) >= {REPEAT_WINDOW})),
rep AS (SELECT r, count(DISTINCT p) AS n_repeat FROM (SELECT r, unnest(range(i, i + {REPEAT_WINDOW})) AS p FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS times FROM win) WHERE times > 1) GROUP BY r),
dup AS (SELECT r, count(*) - count(DISTINCT x) AS n_dup FROM (SELECT r, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY r),
part AS ({counts}),
cls AS (SELECT * FROM part UNION ALL SELECT r, 'symbol', length(t) - n FROM d JOIN (SELECT r, sum(n) AS n FROM part GROUP BY r) USING (r)),
cref(lang, c, q) AS (SELECT * FROM (VALUES {values(chars)}) v(a, b, c)),
cdist AS (SELECT r, min(x) AS x FROM (SELECT r, lang, sqrt(greatest(sum({half}) / 2, 0)) AS x FROM (SELECT cls.r, lang, n / length(t) AS p, q FROM cls JOIN d USING (r) JOIN cref USING (c) WHERE length(t) > 0) GROUP BY r, lang) GROUP BY r),
lw AS (SELECT r, unnest(regexp_extract_all({lower}, '[^\x00-\x60\x7B-\x7F]+')) AS x FROM d),
total AS (SELECT r, count(*) AS n, count(DISTINCT x) AS u FROM lw GROUP BY r),
walone(lang, far) AS (SELECT * FROM (VALUES {values(alone)}) v(a, b)),
wref(lang, x, q) AS (SELECT * FROM (VALUES {values(words)}) v(a, b, c)),
wrest(lang, q) AS (SELECT * FROM (VALUES {values(rest)}) v(a, b)),
hit AS (SELECT r, lang, x, count(*) AS n FROM lw JOIN wref USING (x) GROUP BY ALL),
wp AS (SELECT total.r, wref.lang, coalesce(hit.n, 0) / total.n AS p, q FROM total CROSS JOIN wref LEFT JOIN hit ON hit.r = total.r AND hit.lang = wref.lang AND hit.x = wref.x
  UNION ALL SELECT total.r, wrest.lang, (total.n - coalesce(h.n, 0)) / total.n, q FROM total CROSS JOIN wrest LEFT JOIN (SELECT r, lang, sum(n) AS n FROM hit GROUP BY r, lang) h ON h.r = total.r AND h.lang = wrest.lang),
wdist AS (SELECT r, min(x) AS x, min(x / far) AS share FROM (SELECT r, lang, sqrt(greatest(sum({half}) / 2, 0)) AS x FROM wp GROUP BY r, lang) JOIN walone USING (lang) GROUP BY r),
f AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(n_dup, 0) AS n_dup_lines, coalesce(n_repeat, 0) AS n_repeat_words,
  len(w) < {MIN_BASE_WORDS} OR 100 * coalesce(n_repeat, 0) > {MAX_REPEAT_PERCENT} * len(w) AS base_failed,
  length(t) >= {MIN_CHARS} AND coalesce(cdist.x, 0) > {MAX_CHAR_DISTANCE} OR coalesce(total.n, 0) >= {MIN_WORDS} AND (coalesce(wdist.x, 0) > {MAX_WORD_DISTANCE} OR coalesce(wdist.share, 0) > {MAX_WORD_SHARE} AND total.u * total.u < {FOREIGN_ROOT**2} * total.n) AS diverges
  FROM d LEFT JOIN rep USING (r) LEFT JOIN dup USING (r) LEFT JOIN cdist USING (r) LEFT JOIN wdist USING (r) LEFT JOIN total USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT diverges AS kept FROM f
"""


ORACLE_SQL = _oracle()
