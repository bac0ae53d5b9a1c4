"""Secret scans: patterns propose, structure confirms.

Patterns find three kinds of secrets on their own (assignments, access keys
and hex runs).  Candidates that could be encoded keys are decoded, and only
those whose bytes parse are added: DER with every nested length accounted for,
the OpenSSH key container with its nested lengths, and signed tokens whose
header is JSON that names an algorithm.

A text is scanned whole, in one task, by an Arrow batch function; nothing is
shuffled, so a hot source or a long text costs what its characters cost.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fathomer.llm.arrow import tidy
from fathomer.workspace import bounded_batches

#: Kinds in the order in which spans of equal start are listed.
BASE_KINDS = ("assign", "access", "hex")
ADDED_KINDS = ("pem", "der", "ssh", "token")
KINDS = BASE_KINDS + ADDED_KINDS

_ASSIGN = re.compile(
    r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
_ASSIGN_HINTS = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_MIN_GROUP, _MIN_ACCESS, _MIN_HEX = 12, 18, 16

#: An armoured block: its label, header lines if any, and the body; line breaks may be written as escapes.
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]+)-----((?:(?:\s|\\[nr])*+[A-Z][A-Za-z-]*+:[^\n\\]*+(?=\n|\\[nr]))*+)([A-Za-z0-9+/=\s\\]*?)-----END \1-----")
_CIPHER = re.compile(r"DEK-Info:[ \t]*((?:DES|AES|CAMELLIA|SEED|IDEA|RC2)[A-Z0-9-]*),([0-9A-Fa-f]+)")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}")
_ANY_HEX = re.compile(r"(?:[0-9a-f]{2}){24,}|(?:[0-9A-F]{2}){24,}")
#: Candidates over several lines: line breaks, indentation, and a last line of any length.
_WRAPPED = re.compile(r"[A-Za-z0-9+/_-]{40,}(?:\r?\n[ \t]*+[A-Za-z0-9+/_-]++)++={0,2}")
_BREAK = re.compile(r"\r?\n[ \t]*")
_TOKEN = re.compile(r"(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")

_SSH_NAMES = (b"ssh-rsa", b"ssh-dss", b"ssh-ed25519", b"ecdsa-sha2-nistp256", b"ecdsa-sha2-nistp384", b"ecdsa-sha2-nistp521")
_OPENSSH = b"openssh-key-v1\0"


def _tlv(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, start of content, end of content) of the DER element at ``at``."""
    if at + 2 > end:
        return None
    tag, first, body = data[at], data[at + 1], at + 2
    length = first
    if first >= 0x80:
        width = first & 0x7F
        if not 1 <= width <= 4 or body + width > end:
            return None
        length = int.from_bytes(data[body : body + width], "big")
        if length < 0x80 or (width > 1 and length < 1 << (8 * (width - 1))):
            return None  # DER asks for the shortest form
        body += width
    return (tag, body, body + length) if body + length <= end else None


def _children(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """The elements that fill ``data[at:end]`` exactly; None if they or any nested in them do not."""
    found, todo, top = [], [(at, end)], True
    while todo:
        at, end = todo.pop()
        while at < end:
            item = _tlv(data, at, end)
            if item is None:
                return None
            if top:
                found.append(item)
            if item[0] & 0x20:
                todo.append((item[1], item[2]))
            at = item[2]
        top = False
    return found


def _within(data: bytes) -> list[tuple[int, int, int]]:
    """The elements of a DER sequence that is all of ``data``; none if it is not."""
    outer = _tlv(data, 0, len(data))
    if outer is None or outer[0] != 0x30 or outer[2] != len(data):
        return []
    return _children(data, outer[1], outer[2]) or []


def _names_algorithm(data: bytes, item: tuple[int, int, int]) -> bool:
    """Whether an element is a sequence that begins with an object identifier."""
    return item[0] == 0x30 and item[1] < item[2] and data[item[1]] == 0x06


def is_der_key(data: bytes) -> bool:
    """A DER sequence that is laid out as a private key (PKCS#1, PKCS#8, SEC1)."""
    items = _within(data)
    if len(items) < 2 or items[0][0] != 0x02:
        return False
    tags = [t for t, _, _ in items]
    version = data[items[0][1] : items[0][2]]
    if len(version) != 1 or version[0] > 2:
        return False
    if tags[1] == 0x30 and len(tags) >= 3 and tags[2] == 0x04:  # PKCS#8
        return _names_algorithm(data, items[1])
    if tags[1] == 0x04:  # SEC1
        return items[1][2] - items[1][1] in (20, 24, 28, 32, 48, 66)
    return len(tags) in (6, 9) and set(tags) == {0x02}  # DSA or PKCS#1


def is_sealed_key(data: bytes) -> bool:
    """An encrypted PKCS#8 key: how it is encrypted, and the octets."""
    items = _within(data)
    return len(items) == 2 and _names_algorithm(data, items[0]) and items[1][0] == 0x04 and items[1][2] > items[1][1]


def _is_enciphered(head: str, body: bytes) -> bool:
    """An old encrypted key: the header names a cipher and its start value, and the body is whole blocks of it."""
    cipher = _CIPHER.search(head)
    block = 0 if not cipher else 8 if cipher[1].startswith(("DES", "IDEA", "RC2")) else 16
    return bool(block) and "ENCRYPTED" in head and len(cipher[2]) == 2 * block and len(body) > 0 and len(body) % block == 0


def _fields(data: bytes) -> list[bytes] | None:
    """The length-prefixed fields that fill ``data`` exactly."""
    at, found = 0, []
    while at < len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            return None
        found.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    return found


def is_ssh_key(data: bytes) -> bool:
    """The OpenSSH private key container, its lengths and its public keys checked.

    A public key in SSH wire format is no secret, and so not reported.
    """
    if not data.startswith(_OPENSSH):
        return False
    at = len(_OPENSSH)
    for _ in range(3):  # cipher, derivation, its options
        at += 4 + int.from_bytes(data[at : at + 4], "big")
    count = int.from_bytes(data[at : at + 4], "big")
    blobs = _fields(data[at + 4 :]) if at + 4 <= len(data) else None
    if not blobs or len(blobs) != count + 1 or not 1 <= count <= 16:
        return False
    return all((parts := _fields(blob)) and parts[0] in _SSH_NAMES for blob in blobs[:count])


def _b64(text: str) -> bytes | None:
    plain = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(plain) % 4 == 1:
        return None
    try:
        return base64.b64decode(plain + "=" * (-len(plain) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def is_signed_token(header: str, payload: str) -> bool:
    """A signed token: both parts decode to JSON objects, and the header names an algorithm."""
    for part, need in ((header, "alg"), (payload, None)):
        raw = _b64(part)
        try:
            value = json.loads(raw) if raw is not None else None
        except (ValueError, RecursionError):
            return False
        if not isinstance(value, dict) or (need and not isinstance(value.get(need), str)):
            return False
    return True


def _key_kind(data: bytes | None) -> str | None:
    if not data:
        return None
    if is_der_key(data):
        return "der"
    if is_ssh_key(data):
        return "ssh"
    return "pem" if b"-----BEGIN " in data and _pem_spans(data.decode("latin-1")) else None


def _pem_spans(text: str) -> list[tuple[int, int, str]]:
    """Armoured private keys whose bodies parse."""
    found = []
    for m in _PEM.finditer(text):
        if "PRIVATE KEY" not in m[1]:
            continue
        body = _b64(re.sub(r"\s|\\[nr]", "", m[3])) or b""
        sealed = is_sealed_key(body) if m[1].startswith("ENCRYPTED") else _is_enciphered(m[2], body)
        if sealed or _key_kind(body):
            found.append((m.start(), m.end(), "pem"))
    return found


def _decoded(text: str) -> Iterator[bytes | None]:
    """What a candidate may stand for."""
    if len(text) % 2 == 0 and (not text.strip("0123456789abcdef") or not text.strip("0123456789ABCDEF")):
        yield bytes.fromhex(text)
    yield _b64(text)


def _wrapped_spans(text: str) -> list[tuple[int, int, str]]:
    """Keys over lines of equal length, the last one as long or shorter."""
    found = []
    for m in _WRAPPED.finditer(text):
        lines, at = [], m.start()  # (start, end) of each
        for b in _BREAK.finditer(text, m.start(), m.end()):
            lines.append((at, b.start()))
            at = b.end()
        lines.append((at, m.end()))
        i = 0
        while i < len(lines):
            width = lines[i][1] - lines[i][0]
            j = i + 1
            while j < len(lines) and lines[j][1] - lines[j][0] == width:
                j += 1
            # All lines of this width, and the shorter one behind them or none.
            last = j < len(lines) and lines[j][1] - lines[j][0] < width
            for stop in (j + 1, j) if last else (j,):
                kind = None
                if width >= 40 and stop - i > 1:
                    whole = "".join(text[a:b] for a, b in lines[i:stop])
                    kind = next((k for data in _decoded(whole) if (k := _key_kind(data))), None)
                if kind:
                    found.append((lines[i][0], lines[stop - 1][1], kind))
                    j = stop
                    break
            i = j
    return found


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of what the patterns find alone."""
    found = []
    low = text.lower() if "=" in text or ":" in text else ""
    if any(h in low for h in _ASSIGN_HINTS):
        found += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= _MIN_GROUP]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= _MIN_ACCESS]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def confirmed_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of candidates whose decoded bytes parse."""
    found = []
    if "-----BEGIN " in text:
        found += _pem_spans(text)
    inside = [(a, b) for a, b, _ in found]
    wrapped = [s for s in _wrapped_spans(text) if not any(a <= s[0] and s[1] <= b for a, b in inside)]
    found += wrapped
    inside += [(a, b) for a, b, _ in wrapped]
    covered = lambda m: any(a <= m.start() and m.end() <= b for a, b in inside)
    if "eyJ" in text:
        found += [(m.start(), m.end(), "token") for m in _TOKEN.finditer(text) if is_signed_token(m[1], m[2])]
    for m in _BASE64.finditer(text):
        if not covered(m) and (kind := _key_kind(_b64(m[0]))):
            found.append((m.start(), m.end(), kind))
    for m in _ANY_HEX.finditer(text):
        if not covered(m) and (kind := _key_kind(bytes.fromhex(m[0]))):
            found.append((m.start(), m.end(), kind))
    return found


#: Bytes that a base64 or hex candidate may hold, as a table.
_CODE = np.zeros(256, bool)
_CODE[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"]] = True
_HEX_CODE = np.zeros(256, bool)
_HEX_CODE[[*b"0123456789abcdef"]] = True


def _has_run(table: np.ndarray, data: np.ndarray, least: int) -> bool:
    """Whether ``least`` bytes of the table stand in a row."""
    if len(data) < least:
        return False
    breaks = np.flatnonzero(~table[data])
    if not len(breaks):
        return True
    return bool(max(breaks[0], len(data) - 1 - breaks[-1], (np.diff(breaks).max() - 1) if len(breaks) > 1 else 0) >= least)


def find_secrets(text: str | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, all spans) of a text, sorted by start, then kind."""
    if not text:
        return [], []
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    coded = _has_run(_CODE, data, 40)
    if not coded and "eyJ" not in text and not _has_run(_HEX_CODE, data, _MIN_HEX) and "AKIA" not in text and "=" not in text and ":" not in text and "-----BEGIN " not in text:
        return [], []
    base = base_spans(text)
    added = confirmed_spans(text) if coded or "eyJ" in text or "-----BEGIN " in text else []
    return base, sorted({*base, *added}, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The secrets of every document.

    Returns ``doc_id``, one long ``n_<kind>`` for each of ``BASE_KINDS``,
    ``base_sha256`` (of the base spans' list) and ``spans``, the list of all
    spans as ``kind:start:end`` joined by commas, in code points, end
    exclusive.  A null or empty text has none.  Rows are taken one by one:
    repeated or null ids are kept as they come, other columns are not read,
    and an empty table gives an empty one.
    """
    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in BASE_KINDS) + ", base_sha256 string, spans string"

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            counts: list[list[int]] = [[] for _ in BASE_KINDS]
            digests, lists = [], []
            for text in part.column(1):
                base, spans = find_secrets(text.as_py())
                for k, kind in enumerate(BASE_KINDS):
                    counts[k].append(sum(s[2] == kind for s in base))
                digests.append(hashlib.sha256(_listed(base).encode()).hexdigest())
                lists.append(_listed(spans))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(lists, pa.string())],
                names=["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans"],
            )

    bounded_batches(docs.sparkSession)
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(tidy(batches), schema)
