"""7. Secret scans with structural confirmation.

Three base patterns are reported as they stand.  The method then decodes every run
of 16 or more hex or base64 characters (both alphabets, with the lines that continue
it) and parses what is inside; armoured blocks and dotted tokens are read likewise.
Only what parses is reported as a further span:

* jwt: a signed token; its header is a JSON object that names an algorithm;
* pem: an armoured private key, with or without header lines, or its encoding as a whole;
* der: a key whose nested lengths fill it exactly, at the end of a run or line;
* ssh: an OpenSSH public or private key, by its length-prefixed fields.

A run may also hold any of these in encoded form, once.  A span goes from the run's or
line's start to the end of what it holds; der and ssh spans within a pem span are left out.
Continued lines have one width, but for the first and a shorter last one, so that each
is decoded a bounded number of times.  The work is linear in the text's length.

Null and empty texts have no spans.  Spans are in code points, end exclusive.
Whole texts are scanned; repeated rows are judged alike.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import json
import re
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm.scan import as_id, scan, scan_rows

# Fixed values of the contract: base patterns, least lengths.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{16,}")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
#: Kinds in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "jwt", "pem", "der", "ssh")

#: Characters that a run or a wrapped line must have (a last line may be shorter), and decoded bytes of a key at least.
LEAST_RUN, LEAST_KEY = 16, 24

_BREAK = rb"(?:\r?\n|(?:\\r)?\\n)[ \t]*"
_LONG = re.compile(rb"[A-Za-z0-9+/_-]{16,}")


def _runs(alphabet: bytes) -> tuple[re.Pattern, re.Pattern]:
    """Runs with the lines that continue them, and the lines of one."""
    return re.compile(rb"[%b]{%d,}(?:%b[%b]+)*" % (alphabet, LEAST_RUN, _BREAK, alphabet)), re.compile(rb"(?:%b)?([%b]+)" % (_BREAK, alphabet))


#: (runs, lines, bits of a character, characters in place of + and /)
ENCODINGS = [(*_runs(rb"0-9A-Fa-f"), 4, None), (*_runs(rb"A-Za-z0-9+/"), 6, None), (*_runs(rb"A-Za-z0-9_-"), 6, b"-_")]

_DOTTED = re.compile(rb"[A-Za-z0-9_.=-]{16,}")
_PART = re.compile(rb"[A-Za-z0-9_-]+={0,2}")
_SIGNATURE = re.compile(rb"[A-Za-z0-9_-]*={0,2}")
_BEGIN = re.compile(rb"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----")
_SSH = re.compile(rb"(?:ssh-(?:rsa|dss|ed25519)|ecdsa-sha2-nistp\d{3}) (AAAA[A-Za-z0-9+/]{16,}={0,2})")
_OPENSSH = b"openssh-key-v1\0"


def _decoded(text: bytes, url: bool = False) -> bytes | None:
    text = re.sub(rb"[\s\\=]", b"", text)
    try:
        return base64.b64decode(text + b"=" * (-len(text) % 4), altchars=b"-_" if url else None, validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """(tag, body) of the DER values that fill ``data`` exactly, or None."""
    at, items = 0, []
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > len(data):
                return None
            size = int.from_bytes(data[at:at + n], "big")
            at += n
        if at + size > len(data):
            return None
        items.append((tag, data[at:at + size]))
        at += size
    return items


def is_der_key(data: bytes | None) -> bool:
    """A SEQUENCE that fills the bytes and holds key parts: integers, or an
    algorithm identifier with a bit or octet string."""
    top = der_items(data) if data else None
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return False
    parts = der_items(top[0][1])
    if not parts or len(parts) < 2:
        return False
    tags = [t for t, _ in parts]
    if tags.count(0x02) >= 2 and set(tags) <= {0x02, 0x30}:
        return True
    algorithm = next((b for t, b in parts if t == 0x30), b"")
    inner = der_items(algorithm) if algorithm else None
    return bool(inner and inner[0][0] == 0x06 and {0x03, 0x04} & set(tags)) or (tags[0] == 0x02 and 0x04 in tags)


def is_ssh_key(data: bytes | None) -> bool:
    """Length-prefixed fields that fill the bytes, the first a key type."""
    at, fields = 0, []
    while data and at + 4 <= len(data):
        n = int.from_bytes(data[at:at + 4], "big")
        fields.append(data[at + 4:at + 4 + n])
        at += 4 + n
    return bool(data) and at == len(data) and len(fields) >= 2 and re.match(rb"ssh-|ecdsa-", fields[0]) is not None


def openssh_length(data: bytes) -> int | None:
    """Bytes of the OpenSSH private key that ``data`` starts with, or None: cipher,
    kdf and its options, as many public keys as it says, and the private part."""
    at, keys = len(_OPENSSH), None
    if not data.startswith(_OPENSSH):
        return None
    fields = 0
    while keys is None or fields < 3 + keys + 1:
        if fields == 3 and keys is None:
            keys, at = int.from_bytes(data[at:at + 4], "big"), at + 4
            continue
        at += 4 + int.from_bytes(data[at:at + 4], "big")
        fields += 1
        if at > len(data):
            return None
    return at if keys else None


def der_length(data: bytes) -> int | None:
    """Bytes of the DER key that ``data`` starts with, or None."""
    if len(data) < LEAST_KEY or data[0] != 0x30:
        return None
    n = data[1] & 0x7F if data[1] & 0x80 else 0
    size = 2 + n + (int.from_bytes(data[2:2 + n], "big") if n else data[1])
    return size if n <= 4 and LEAST_KEY <= size <= len(data) and is_der_key(data[:size]) else None


def is_signed_token(token: bytes) -> bool:
    """header.payload.signature, the first two base64url JSON objects, ``alg`` named."""
    parts = token.split(b".")
    try:
        header, body = (json.loads(_decoded(p, url=True) or b"") for p in parts[:2])
    except (ValueError, UnicodeDecodeError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str) and isinstance(body, dict)


def _is_pem(body: bytes) -> bool:
    """Base64 lines that hold a key; with header lines that say so, an encrypted one (whole cipher blocks)."""
    lines = body.replace(b"\\r", b"").replace(b"\\n", b"\n").split(b"\n")
    data = _decoded(b"".join(x for x in lines if b":" not in x))
    if not data:
        return False
    if any(x.strip().startswith(b"Proc-Type:") and b"ENCRYPTED" in x for x in lines):
        return len(data) >= LEAST_KEY and len(data) % 8 == 0
    return is_der_key(data) or data.startswith(_OPENSSH)


def _tokens(raw: bytes) -> list[tuple[int, int, str]]:
    found = []
    for m in _DOTTED.finditer(raw) if b"eyJ" in raw else ():
        parts, at, k = m.group().split(b"."), m.start(), 0
        while k + 2 < len(parts):
            head = parts[k].find(b"eyJ")
            if head >= 0 and _PART.fullmatch(parts[k], head) and _PART.fullmatch(parts[k + 1]) and is_signed_token(parts[k][head:] + b"." + parts[k + 1]):
                end = at + len(parts[k]) + len(parts[k + 1]) + 2 + _SIGNATURE.match(parts[k + 2]).end()
                found.append((at + head, end, "jwt"))
                at, k = at + sum(len(p) + 1 for p in parts[k:k + 3]), k + 3
            else:
                at, k = at + len(parts[k]) + 1, k + 1
    return found


def _armoured(raw: bytes) -> list[tuple[int, int, str]]:
    found = []
    for m in _BEGIN.finditer(raw) if b"PRIVATE KEY-----" in raw else ():
        end, last = raw.find(b"-----", m.end()), b"-----END " + m.group(1) + b"-----"
        if end >= 0 and raw.startswith(last, end) and _is_pem(raw[m.end():end]):
            found.append((m.start(), end + len(last), "pem"))
    return found


def _held(data: bytes, nested: int) -> tuple[int, int, bool, str] | None:
    """(first byte, end, whether it must end a line, kind) of what decoded ``data`` holds, or None."""
    if n := der_length(data):
        return 0, n, True, "der"
    if n := openssh_length(data):
        return 0, n, True, "ssh"
    inner = structures(data, nested - 1) if nested else []
    return (inner[0][0], max(e for _, e, _ in inner), False, inner[0][2]) if inner else None


def _encoded(raw: bytes, nested: int) -> list[tuple[int, int, str]]:
    """What the runs of ``raw`` hold in encoded form."""
    found = []
    for runs, line, bits, other in ENCODINGS if _LONG.search(raw) else ():
        for run in runs.finditer(raw):
            lines = [m.span(1) for m in line.finditer(raw, run.start(), run.end())]
            ends = list(accumulate(e - s for s, e in lines))  # in characters, breaks left out
            widths = [e - s for s, e in lines]
            k = fresh = 0
            while k < len(lines):
                # a line as wide as the one before stands alone; others have the lines of one width after them, and a shorter last one
                last = k + 1
                if last < len(lines) and (k == fresh or widths[k] != widths[k - 1]):
                    while last < len(lines) and widths[last] == widths[k + 1]:
                        last += 1
                    last += last < len(lines) and widths[last] < widths[k + 1]
                for stop in (last, k + 1) if last > k + 1 else (last,):
                    held = _held(_bytes(b"".join(raw[s:e] for s, e in lines[k:stop]), bits, other), nested)
                    if not held:
                        continue
                    first, end, whole, kind = held
                    before = ends[k] - widths[k]
                    at = bisect.bisect_left(ends, before - (-end * 8 // bits))
                    if whole and ends[at] != before - (-end * 8 // bits):
                        continue
                    close = lines[at][1]
                    if bits == 6:
                        close += len(raw[close:close + 2]) - len(raw[close:close + 2].lstrip(b"="))
                    found.append((lines[bisect.bisect_right(ends, before + first * 8 // bits)][0], close, kind))
                    k, fresh = at, at + 1
                    break
                k += 1
    return found


def _bytes(text: bytes, bits: int, other: bytes | None) -> bytes:
    if bits == 4:
        return bytes.fromhex(text[:len(text) // 2 * 2].decode())
    text = text[:len(text) - (len(text) % 4 == 1)]
    return base64.b64decode(text + b"=" * (-len(text) % 4), altchars=other)


def structures(raw: bytes, nested: int = 1) -> list[tuple[int, int, str]]:
    """The spans in bytes of all that parses, encoded ``nested`` times more at most, by start and then kind."""
    blocks = _armoured(raw)
    found = _tokens(raw) + _encoded(raw, nested)
    if b" AAAA" in raw:
        found += [(m.start(), m.end(), "ssh") for m in _SSH.finditer(raw) if is_ssh_key(_decoded(m.group(1)))]
    starts = [s for s, _, _ in blocks]

    def outside(span):
        k = bisect.bisect_right(starts, span[0]) - 1
        return k < 0 or span[1] > blocks[k][1]

    return sorted(blocks + [x for x in set(found) if outside(x)], key=_order)


def _order(span: tuple[int, int, str]):
    return span[0], KINDS.index(span[2]), span[1]


def byte_spans(raw: bytes) -> list[tuple[int, int, str]]:
    """(start, end, kind) in bytes, by start and then kind."""
    found = []
    low = raw.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(raw) if m.end(2) - m.start(2) >= 12]
    if b"AKIA" in raw:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(raw) if m.end() - m.start() >= 18]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(raw)]
    return sorted(found + structures(raw), key=_order)


def text_spans(raw: bytes) -> list[tuple[int, int, str]]:
    """``byte_spans`` in code points."""
    found = byte_spans(raw)
    if not found or raw.isascii():
        return found
    at, n, point = 0, 0, {}
    for b in sorted({x for s, e, _ in found for x in (s, e)}):
        n += len(raw[at:b].decode("utf-8", "replace"))
        at, point[b] = b, n
    return [(point[s], point[e], kind) for s, e, kind in found]


def _raw(column: pa.Array):
    return (b"" if t is None else t for t in column.cast(pa.large_binary()).to_pylist())


def secret_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: counts by base kind, a digest of the base spans, and all spans."""

    def make():
        def work(batch):
            out = {c: [] for c in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")}
            for raw in _raw(batch.column(1)):
                found = text_spans(raw)
                base = [x for x in found if x[2] in KINDS[:3]]
                for kind in KINDS[:3]:
                    out[f"n_{kind}"].append(sum(x[2] == kind for x in base))
                say = lambda xs: ",".join(f"{k}:{s}:{e}" for s, e, k in xs)
                out["base_sha256"].append(hashlib.sha256(say(base).encode()).hexdigest())
                out["spans"].append(say(found))
            return out | {doc_id: batch.column(0)}
        return work

    return scan(docs, [as_id(doc_id), text], make,
                f"{doc_id} long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact_secrets(docs: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """The documents with every reported span replaced by ``mark``; a null text stays null."""
    sign = mark.encode()

    def make():
        def work(column: pa.Array):
            texts = column.to_pylist()
            for i, raw in enumerate(_raw(column)):
                if found := byte_spans(raw):
                    out, at = [], 0
                    for s, e, _ in found:
                        if s >= at:
                            out += [raw[at:s], sign]
                        at = max(at, e)
                    texts[i] = b"".join([*out, raw[at:]]).decode("utf-8", "replace")
            return [True] * len(texts), texts
        return work

    return scan_rows(docs, text, make)
