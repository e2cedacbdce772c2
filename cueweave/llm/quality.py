"""Quality rules, line first: clean every line, then judge the document by what is left.

Every line is put to the line rules (``LINE_RULES``): punctuation, navigation,
boilerplate, and a line that repeats an earlier one of its document. Lines that
fail are removed; a document is rejected if the base rules fail it, if no word
is left, or if the removed lines held more than ``MAX_LOST`` of its word
characters. One pass over the texts; repeated 8-word windows are numbered
exactly (by doubling), for all texts of a slice together.

Defined results: a null text is empty; a text without words has zero counts and
fails the base rules; rows that repeat come out as often as they stand; other
columns of the table are not touched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from cueweave.llm.common import slices, strings, sums, texts

MIN_WORDS = 20
#: Percent of words in repeated windows above which the base rules fail a text.
MAX_REPEATED = 30
WINDOW = 8  # a power of two
#: Share of word characters in removed lines above which a document is rejected.
MAX_LOST = 0.5

#: Symbol marks, marks of excitement, ASCII white space, and what stands between the links of a menu.
SYMBOLS = b"#*$%&|<>"
SHOUTS = b"!?"
BLANKS = b" \t\n\x0b\x0c\r"
SEPARATORS = frozenset(["|", "»", ">", "•", "·", "/", "::", "›"])
#: Phrases of page furniture, lower case.
BOILERPLATE = (
    "all rights reserved", "cookie policy", "use of cookies", "accept cookies", "privacy policy", "terms of service", "terms of use",
    "enable javascript", "javascript is disabled", "sign up for our newsletter", "subscribe to our newsletter", "skip to content",
    "skip to main content", "share on facebook", "share on twitter", "click here to", "log in to comment", "powered by wordpress",
)
#: A line of so many words at most is page furniture if a boilerplate phrase stands in it; longer ones are prose about it.
FURNITURE_WORDS = 20


def ascii_words(line: str) -> list[str]:
    """What stands between ASCII white space."""
    return _WORD.findall(line)


_WORD = re.compile("[^\x20\x09-\x0d]+")


def marks(line: str) -> int:
    raw = line.encode("utf-8", "surrogatepass")
    return len(raw) - len(raw.translate(None, SYMBOLS + SHOUTS))


def punctuation(line: str) -> bool:
    """More marks than a third of the words (and two)."""
    found = marks(line)
    return found > 2 and 3 * found > len(ascii_words(line)) + 6


def navigation(line: str) -> bool:
    """Links in a row: a separator for every three other words, three at least."""
    words = ascii_words(line)
    between = sum(w in SEPARATORS for w in words)
    return between >= 3 and 3 * between >= len(words) - between


def boilerplate(line: str) -> bool:
    return has_phrase(line) and len(ascii_words(line)) <= FURNITURE_WORDS


def has_phrase(text: str) -> bool:
    lowered = text.lower()
    return any(p in lowered for p in BOILERPLATE)


#: Each rule behind a test of the whole text without which none of its lines can fail.
LINE_RULES = (
    (lambda text: marks(text) > 2, punctuation),
    (lambda text: any(s in text for s in SEPARATORS), navigation),
    (has_phrase, boilerplate),
)


def word_chars(text: str) -> int:
    """Code points in words."""
    raw = text.encode("utf-8", "surrogatepass")
    return len(text) - (len(raw) - len(raw.translate(None, BLANKS)))


def clean_lines(text: str, rules=LINE_RULES) -> tuple[str, int, int]:
    """The lines that pass; word characters in the others; lines that repeat an earlier one.

    Of equal lines the first stays. Lines without a word stay and have no say.
    """
    rules = [rule for can, rule in rules if can(text)]
    seen, out, lost, again = set(), [], 0, 0
    for line in text.split("\n"):
        repeated = line in seen
        if not repeated and not rules:
            seen.add(line)
            out.append(line)
            continue
        if not _WORD.search(line):
            out.append(line)
            continue
        seen.add(line)
        again += repeated
        if repeated or any(rule(line) for rule in rules):
            lost += word_chars(line)
        else:
            out.append(line)
    return "\n".join(out), lost, again


def repeated_words(codes: np.ndarray, offsets: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Words of each text inside windows that it holds at least twice.

    ``codes``: the words of all texts as numbers from 0. Windows are numbered
    exactly, by doubling: the numbers of two neighbours make the number of a
    window twice as long, and only those with both halves repeated go on.
    """
    n, size = len(codes), 1
    codes = codes.astype(np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    left = offsets[1:][text] - np.arange(n)  # words from here to the text's end
    most = int(codes.max(initial=0)) + 1
    number = text * np.int64(most) + codes  # so equal windows are in one text
    if int(number.max(initial=0)) * most >= 2**62:
        number = np.unique(number, return_inverse=True)[1]
    first, second, at = number, codes, np.arange(n)
    while size < window:
        at = at[left[at] >= 2 * size]
        at = at[(first[at] >= 0) & (second[at + size] >= 0)]
        again, label = _twice(first[at] * np.int64(most) + second[at + size])
        at, most = at[again], int(label.max(initial=0)) + 1
        first = second = np.full(n, -1, np.int64)
        first[at] = label[again]
        size *= 2
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + window, -1)
    return sums(np.cumsum(cover[:-1]) > 0, offsets)


def _twice(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occur twice or more, and a number for each of those."""
    order = np.sort(key)
    found = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(found):
        return np.zeros(len(key), bool), np.zeros(len(key), np.int64)
    label = np.minimum(np.searchsorted(found, key), len(found) - 1)
    return found[label] == key, label


def word_codes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The words (between ASCII white space) of each text as numbers, and the texts' offsets."""
    lists = pc.ascii_split_whitespace(array)
    parts = np.asarray(lists.offsets).astype(np.int64) - lists.offsets[0].as_py()
    flat = lists.flatten()
    real = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0  # white space at an end leaves an empty part
    offsets = np.concatenate([[0], np.cumsum(real)])[parts]
    if not real.all():
        flat = flat.filter(pa.array(real))
    return flat.dictionary_encode().indices.to_numpy(), offsets


def judge(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """Counts, verdicts and (``cleaned``) the lines that stay, for every document."""
    fields = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, lost double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            array = strings(batch)
            codes, offsets = word_codes(array)
            n_words, repeats = np.diff(offsets), repeated_words(codes, offsets)
            text = array.to_numpy(zero_copy_only=False)
            raw = [t.encode("utf-8", "surrogatepass") for t in text]
            symbols = np.array([len(r) - len(r.translate(None, SYMBOLS)) for r in raw], np.int64)
            chars = np.array([len(t) - (len(r) - len(r.translate(None, BLANKS))) for t, r in zip(text, raw, strict=True)], np.int64)
            lines = [clean_lines(t) for t in text]
            lost, again = (np.array([x[k] for x in lines], np.int64) for k in (1, 2))
            failed = (n_words < MIN_WORDS) | (100 * repeats > MAX_REPEATED * n_words)
            share = lost / np.maximum(chars, 1)
            columns = {
                "doc_id": batch.column("doc_id"), "n_words": pa.array(n_words), "word_chars": pa.array(chars), "n_symbols": pa.array(symbols),
                "n_dup_lines": pa.array(again), "n_repeat_words": pa.array(repeats), "base_failed": pa.array(failed),
                "kept": pa.array(~failed & (chars > lost) & (share <= MAX_LOST)), "lost": pa.array(share),
            }
            yield pa.record_batch(columns | ({"cleaned": pa.array([x[0] for x in lines], pa.string())} if with_text else {}))

    rows = texts(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, {fields}" + ", cleaned string" * with_text)
