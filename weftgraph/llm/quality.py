"""Line-first cleaning: rules judge each line, failing lines go, and a document that loses too much text is rejected."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weftgraph.llm.shared import slices, utf8
from weftgraph.llm.textvec import word_hashes, windows, words

#: Signs that end a sentence, signs between the entries of a menu, and phrases of page furniture.
SENTENCE_ENDS = ".!?…。！？؟।"
CLOSING = "\"'”’»)]}*_"
MENU_SIGNS = "|»›>•·"
BOILERPLATE = (
    "all rights reserved", "cookie policy", "privacy policy", "terms of service", "terms of use", "sign in", "sign up",
    "log in", "subscribe to", "click here", "read more", "share this", "follow us", "enable javascript", "lorem ipsum",
    "powered by", "skip to content", "back to top", "add to cart", "licensed under",
)


@dataclass(frozen=True)
class QualityRules:
    """min_words, max_repeat_percent: the base rules of the whole text. short_line: a line of fewer words needs a
    sentence end. menu_share: menu signs per word that mark navigation. boilerplate_words: a line of at most so many
    words with a boilerplate phrase fails. symbol_share: `#*$%&|<>` per word that mark a line as garbled.
    max_lost: the share of a document's word characters that failing lines may hold."""

    min_words: int = 20
    max_repeat_percent: int = 30
    short_line: int = 4
    menu_share: float = 0.3
    boilerplate_words: int = 40
    symbol_share: float = 0.5
    max_lost: float = 0.5


_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_MENU = re.compile("[" + re.escape(MENU_SIGNS) + "]")
_SYMBOL = re.compile(r"[#*$%&|<>]")
_FURNITURE = re.compile("|".join(map(re.escape, BOILERPLATE)))


def line_fails(line: str, rules: QualityRules) -> bool:
    """Whether a line with a word is navigation, boilerplate, garbled, or a short line that ends no sentence."""
    n = len(line.encode().split())
    if len(_MENU.findall(line)) >= max(2, rules.menu_share * n):
        return True
    if n <= rules.boilerplate_words and _FURNITURE.search(line.lower()):
        return True
    if len(_SYMBOL.findall(line)) >= rules.symbol_share * n and n >= 2:
        return True
    return n < rules.short_line and line.rstrip().rstrip(CLOSING)[-1:] not in SENTENCE_ENDS


def clean_lines(text: str, rules: QualityRules) -> tuple[str, float]:
    """The text without failing lines (lines without a word stay), and the share of word characters lost."""
    kept, lost, total = [], 0, 0
    for line in text.split("\n"):
        size = sum(map(len, line.split()))
        total += size
        if size and line_fails(line, rules):
            lost += size
        else:
            kept.append(line)
    return "\n".join(kept), lost / total if total else 0.0


def repeated_words(data: np.ndarray, offsets: np.ndarray, k: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """For each text: its words, and those in k-word windows that the text holds twice or more."""
    starts, ends, by_text = words(data, offsets)
    count = np.diff(by_text)
    text = np.repeat(np.arange(len(count)), count)
    place = np.arange(len(text)) - by_text[text]
    at = np.flatnonzero(place + k <= count[text])
    covered = np.zeros(len(text) + 1, np.int64)
    if len(at):
        h, t = windows(word_hashes(data, starts, ends), k)[at], text[at]
        order = np.lexsort((h, t))
        same = (h[order][1:] == h[order][:-1]) & (t[order][1:] == t[order][:-1])
        twice = np.zeros(len(at), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        np.add.at(covered, at[twice], 1)
        np.add.at(covered, at[twice] + k, -1)
    return count, np.bincount(text[np.cumsum(covered)[:-1] > 0], minlength=len(count))


def _judge(part: pa.RecordBatch, rules: QualityRules, texts: list[str]) -> dict[str, list]:
    data, offsets = utf8(part.column(part.schema.get_field_index("text")))
    n_words, repeats = repeated_words(data, offsets)
    sums = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])
    spaces = np.zeros(256, bool)
    spaces[[0x20, *range(0x09, 0x0E)]] = True
    points = ((data & 0xC0) != 0x80) & ~spaces[data]
    out = {"n_words": n_words.tolist(), "word_chars": sums(points).tolist(), "n_symbols": sums(_SYMBOLS[data]).tolist(), "n_dup_lines": [], "n_repeat_words": repeats.tolist(), "base_failed": [], "kept": [], "lost": [], "cleaned": []}
    for text, n, again in zip(texts, out["n_words"], out["n_repeat_words"], strict=True):
        lines = [x for x in text.encode().split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
        failed = n < rules.min_words or 100 * again > rules.max_repeat_percent * n
        cleaned, lost = clean_lines(text, rules)
        for k, v in (("n_dup_lines", len(lines) - len(set(lines))), ("base_failed", failed), ("kept", not failed and lost <= rules.max_lost), ("lost", lost), ("cleaned", cleaned)):
            out[k].append(v)
    return out


_KINDS = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "base_failed": "boolean", "kept": "boolean", "lost": "double", "cleaned": "string"}


def judge_documents(docs: DataFrame, rules: QualityRules | None = None, keep: tuple[str, ...] = ("doc_id",), cleaned: bool = False) -> DataFrame:
    """The columns `keep`, the counts of _KINDS, base_failed, kept, lost and, on request, the cleaned text, for each row.

    Works row by row over whole texts without a shuffle. A null text counts as empty: 0 words, base_failed. Repeated
    rows are judged alike; other columns are not read, so their names don't matter.
    """
    rules = rules or QualityRules()
    made = [k for k in _KINDS if cleaned or k != "cleaned"]
    schema = ", ".join([f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep] + [f"{k} {_KINDS[k]}" for k in made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [t or "" for t in part.column(part.schema.get_field_index("text")).to_pylist()]
                found = _judge(part, rules, texts)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), *(pa.array(found[k]) for k in made)], names=[*keep, *made])

    columns = [*keep] + ["text"] * ("text" not in keep)
    return docs.select(*columns).mapInArrow(run, schema)
