"""Secret scans with structural confirmation.

Three patterns report on sight (``assign``, ``access``, ``hex``). All other
candidates are reported only after they have been decoded and parsed:

* ``pem``  - an armoured private key whose body decodes to a key structure,
* ``jwt``  - a signed token whose header and payload are JSON objects and whose
  header names an algorithm,
* ``key``  - a base64 or hex run that decodes to a DER private key (every nested
  length adds up) or to an OpenSSH key container.

Defined results: a null or empty text has no spans. Every input row gives one
output row, repeated or null ids included. Input columns other than the id and
the text are ignored, whatever their names. Offsets count code points.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The base patterns and their least lengths.
ASSIGN = re.compile(
    r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
BASE_KINDS = ("assign", "access", "hex")
CONFIRMED_KINDS = ("pem", "jwt", "key")
KINDS = BASE_KINDS + CONFIRMED_KINDS
RANK = {k: i for i, k in enumerate(KINDS)}
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api")

LONG_HEX = re.compile(r"[0-9a-f]{32,}")
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*)PRIVATE KEY-----")
JWT = re.compile(r"(?<![A-Za-z0-9_-])(e[A-Za-z0-9_-]{9,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)")
B64_RUN = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}")
HEX_RUN = re.compile(r"[0-9A-Fa-f]{64,}")
SPAN_TYPE = "array<struct<kind:string,start:long,end:long>>"

Span = tuple[str, int, int]


def _b64(text: str) -> bytes | None:
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(data: bytes) -> list | None:
    """``[(tag, contents)]`` where the contents of a constructed value are such a
    list again; None unless each nested length fills its parent exactly. However deep
    values are nested, each level takes two bytes at least."""
    top: list = []
    open_: list[tuple[list, int]] = [(top, len(data))]  # values begun, and where they end
    at = 0
    while open_:
        items, end = open_[-1]
        if at == end:
            open_.pop()
            continue
        if at + 2 > end:
            return None
        tag, length = data[at], data[at + 1]
        at += 2
        if length >= 0x80:
            n = length & 0x7F
            if not 1 <= n <= 4 or at + n > end:
                return None
            length = int.from_bytes(data[at : at + n], "big")
            if length < 0x80 or length < 1 << 8 * (n - 1):
                return None  # DER has the shortest form of a length only
            at += n
        if at + length > end:
            return None
        if tag & 0x20:
            inner: list = []
            items.append((tag, inner))
            open_.append((inner, at + length))
        else:
            items.append((tag, data[at : at + length]))
            at += length
    return top


def is_der_private_key(data: bytes) -> bool:
    """PKCS#1, DSA, PKCS#8 (plain or encrypted) or SEC1 structure."""
    if len(data) < 24 or data[0] != 0x30:
        return False
    top = der_items(data)
    if not top or len(top) != 1 or not isinstance(top[0][1], list):
        return False
    tags = [t for t, _ in top[0][1]]
    parts = top[0][1]
    if tags[:1] == [0x02]:
        if len(tags) >= 6 and all(t == 0x02 for t in tags[:6]):
            return True  # version and at least five numbers
        if tags[:3] == [0x02, 0x30, 0x04]:
            return bool(parts[1][1]) and parts[1][1][0][0] == 0x06
        return tags[:2] == [0x02, 0x04] and parts[0][1] == b"\x01" and len(parts[1][1]) >= 16
    return tags == [0x30, 0x04] and bool(parts[0][1]) and parts[0][1][0][0] == 0x06 and len(parts[1][1]) >= 16


def is_openssh_key(data: bytes) -> bool:
    """``openssh-key-v1``: the length-prefixed fields fit into the container."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    at = len(magic)
    for _ in range(3):  # cipher, key derivation, its options
        if at + 4 > len(data):
            return False
        at += 4 + int.from_bytes(data[at : at + 4], "big")
    return at + 8 <= len(data) and 1 <= int.from_bytes(data[at : at + 4], "big") <= 64


def is_key(data: bytes | None) -> bool:
    return bool(data) and (is_der_private_key(data) or is_openssh_key(data))


def is_signed_token(header: str, payload: str) -> bool:
    try:
        head, body = (json.loads(_b64(x) or b"") for x in (header, payload))
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(body, dict)


def base_spans(text: str) -> list[Span]:
    out: list[Span] = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return out


def armoured(text: str) -> Iterator[tuple[int, int, str]]:
    """Begin, end and body of armoured private keys, however long: a body ends where the
    next five dashes stand, which must be its own end mark."""
    for m in PEM.finditer(text):
        at = text.find("-----", m.end())
        mark = f"-----END {m[1]}PRIVATE KEY-----"
        if at >= 0 and text.startswith(mark, at):
            yield m.start(), at + len(mark), text[m.end() : at]


def find_secrets(text: str | None) -> list[Span]:
    """All spans of a text by start, then kind as listed in ``KINDS``."""
    if not text:
        return []
    out = base_spans(text)
    # A run of 32 characters needs a word of that length; most texts have none.
    longest = max(map(len, text.split()), default=0)
    if longest >= 32:
        # A maximal run of 32 or more is what the unbounded pattern finds as well.
        out += [("hex", m.start(), m.end()) for m in LONG_HEX.finditer(text)]
    if longest >= 16:
        out += [("jwt", m.start(), m.end()) for m in JWT.finditer(text) if is_signed_token(m[1], m[2])]
    taken: list[tuple[int, int]] = []
    if "PRIVATE KEY-----" in text:
        for start, end, body in armoured(text):
            # Header lines (Proc-Type, DEK-Info) hold a colon; the rest is the key.
            lines = [x for x in re.split(r"\s+|\\n|\\r", body) if x and ":" not in x and "," not in x]
            data = _b64("".join(lines))
            if is_key(data) or ("ENCRYPTED" in body and data and len(data) >= 64):
                out.append(("pem", start, end))
                taken.append((start, end))
    if longest >= 40:
        for pattern, decode in ((B64_RUN, _b64), (HEX_RUN, _hex)):
            for m in pattern.finditer(text):
                if not any(a <= m.start() < b for a, b in taken) and is_key(decode(m[0])):
                    out.append(("key", m.start(), m.end()))
                    taken.append((m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], RANK[s[0]], s[2]))


def _hex(text: str) -> bytes | None:
    return bytes.fromhex(text) if len(text) % 2 == 0 else None


def _as_text(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``spans`` and ``base_digest`` (SHA-256 of the base spans) per row."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [find_secrets(t) for t in b["text"]]
            base = [_as_text([s for s in f if s[0] in BASE_KINDS]) for f in found]
            yield pd.DataFrame(
                {
                    "id": b["id"],
                    "spans": [[{"kind": k, "start": a, "end": e} for k, a, e in f] for f in found],
                    "base_digest": [hashlib.sha256(x.encode()).hexdigest() for x in base],
                }
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        .mapInPandas(scan, f"id {kind}, spans {SPAN_TYPE}, base_digest string")
        .withColumnRenamed("id", id_col)
    )


def redact(text: str | None) -> str | None:
    """``text`` with each secret (overlapping ones merged) replaced by ``[secret]``."""
    spans = find_secrets(text)
    if not spans:
        return text
    out, at = [], 0
    for _, a, b in sorted(spans, key=lambda s: s[1:]):
        if a >= at:
            out += [text[at:a], "[secret]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with secrets replaced in ``text_col``; other columns stay."""


    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(redact)

    return docs.withColumn(text_col, clean(text_col))


def span_text(col) -> F.Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(col, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
