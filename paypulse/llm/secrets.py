"""Secret scans: fixed patterns, and random strings that a tokenizer's vocabulary compresses badly.

A string of several kinds of characters that no word explains falls into many short tokens: few characters per token
expose it. How few is calibrated by length, on keys generated in the alphabets that secrets come in. Digests of known lengths,
UUIDs, names and numbers joined by separators, addresses and links are no secrets by themselves and are left out first.
"""

from __future__ import annotations

import base64
import functools
import random
import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

from paypulse.llm.spans import Span, find_spans, in_order

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "random")
#: A random string has so many characters at least.
RANDOM_CHARS = 16
#: The calibration: share of the generated keys that the ratio lets through, lengths, and keys of each length and alphabet.
CALIBRATED_RECALL, KEY_LENGTHS, KEYS = 0.985, (16, 20, 24, 32, 48, 64), 250

# Alphabets of generated keys (base64 with both pairs of extra characters, base62, base32, lower-case serials).
_UPPER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ALPHABETS = {
    "base64": _UPPER + _UPPER.lower() + _DIGITS + "+/", "base64url": _UPPER + _UPPER.lower() + _DIGITS + "-_",
    "base62": _UPPER + _UPPER.lower() + _DIGITS, "base32": _UPPER + "234567", "lower": _UPPER.lower() + _DIGITS,
}

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_RANDOM = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}={0,2}(?![A-Za-z0-9])" % RANDOM_CHARS)
#: Some text that any of the patterns can be found in; RE2.
_LIKELY = r"(?i)password|passwd|secret|token|api_?key|akia|[0-9a-z+/=_-]{16}"
_DIGEST = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)")
_DIGEST_CHARS = frozenset((32, 40, 48, 56, 64, 96, 128))
_UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
#: A part of a name: a word, or a number, or a short word with a short number.
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,8}|[0-9]{2}T[0-9]{2}|(?:[a-z]{1,10}|[A-Z]{1,10})[0-9]{1,3}")


def _looks_mixed(text: str) -> bool:
    """Digits and letters, or letters of both cases other than a capital at the start."""
    letters = [c for c in text if c.isalpha()]
    return bool(letters) and (any(c.isdigit() for c in text) or any(c.isupper() for c in letters[1:]) and any(c.islower() for c in letters))


def _known(text: str, before: str, after: str) -> bool:
    """Whether a candidate is a digest, an identifier or part of an address or link."""
    if len(text) in _DIGEST_CHARS and _DIGEST.fullmatch(text) or _UUID.fullmatch(text):
        return True
    if before in ("@", ":") and text.startswith("//") or before == "@" or after == "@":
        return True
    parts = [p for p in re.split(r"[_/=+-]+", text) if p]
    return len(parts) > 1 and all(_PART.fullmatch(p) for p in parts)


def generated_keys(alphabet: str, length: int, n: int) -> list[str]:
    """Random keys, the same in every process."""
    rng = random.Random(f"{alphabet} {length}")
    return ["".join(rng.choices(alphabet, k=length)) for _ in range(n)]


def calibrate(tokens: Callable[[str], int]) -> Callable[[int], float]:
    """Characters per token, by length, that ``CALIBRATED_RECALL`` of the generated keys of any alphabet stay within."""
    most = [
        max(np.quantile([n / tokens(k) for k in generated_keys(a, n, KEYS)], CALIBRATED_RECALL) for a in ALPHABETS.values())
        for n in KEY_LENGTHS
    ]
    return lambda length: float(np.interp(length, KEY_LENGTHS, most))


@functools.lru_cache(maxsize=2)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=2)
def _scales(path: str) -> tuple[Callable[[str], int], Callable[[int], float]]:
    encoding = _encoding(path)

    def tokens(text: str) -> int:
        return len(encoding.encode_ordinary(text))

    return tokens, calibrate(tokens)


def base_spans(text: str) -> list[Span]:
    """Leftmost matches that don't overlap within a kind, without those that are too short."""
    out = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return out


def random_spans(text: str, tokens: Callable[[str], int], limit: Callable[[int], float]) -> list[Span]:
    """Random strings; ``tokens`` counts the tokens of a string, ``limit`` tells how many characters per token are too few."""
    out = []
    for m in _RANDOM.finditer(text):
        start, end = m.span()
        if not _looks_mixed(m[0]) or _known(m[0], text[start - 1 : start], text[end : end + 1]):
            continue
        body = m[0].rstrip("=")
        if len(body) <= limit(len(body)) * tokens(body):
            out.append(("random", start, end))
    return out


def find_secrets(
    docs: DataFrame, vocabulary_path: str, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """(doc_id, spans) of all rows: kinds ``KINDS`` by start, then kind; places in code points, end exclusive.

    Random strings may lie in spans of a base kind, which stay as they are. Null and empty texts have no spans; rows are judged one by one, so
    repeated rows, ties and null ids need no rule, and an empty table gives an empty result. Other columns are not read.
    """

    def make_finder():
        tokens, limit = _scales(vocabulary_path)

        def find(text: str) -> list[Span]:
            return in_order(base_spans(text) + random_spans(text, tokens, limit), KINDS)

        return find

    return find_spans(docs, _LIKELY, make_finder, id_column, text_column)
