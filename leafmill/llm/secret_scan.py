"""Secret scans: plain patterns, and structural confirmation of encoded keys and signed tokens.

Candidates of base64 or hex are decoded and parsed before they are reported: key encodings must be DER whose
nested lengths add up and whose fields are those of a key (PKCS#8 plain or encrypted, RSA, DSA, elliptic curve, public
keys), the key inside parsed by its algorithm; in a line, over lines of one length, between marks with headers and line
ends real or escaped, or encoded once more as a whole; OpenSSH keys must have the magic and length-prefixed fields,
signed tokens a JSON header that names an algorithm, whatever stands before them.  One scan, no shuffle.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from leafmill.llm.common import batch, id_and_text, numbered, place, slices, strings
from leafmill.llm.spans import SPAN_SQL, SPAN_TYPE, Span, as_dicts, joined, sha256

#: Base kinds first, in the order that ties at one start take.
KINDS = ("assign", "access", "hex", "signed_token", "private_key", "public_key", "ssh_key")
RANK = {k: i for i, k in enumerate(KINDS)}

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
# a run under the least length holds no match, so these say the same as + and a later check
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
WORD, TOKEN_REST = re.compile(r"[A-Za-z0-9_-]*"), re.compile(r"\.[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]*")
#: Brackets, and quotes with the backslashes before them.
JSON_MARK = re.compile(rb'[{}\[\]]|\\*"')
#: Where a token's header can begin: at the bound of a word with base64 of a brace and what may follow it in JSON.
HEADER = re.compile(r"(?<![A-Za-z0-9_])e(?:yJ|yA|wo|w0|wk|30)")
#: Characters of a key's base64 over lines, and of one of its lines, at most; a longer one is looked for in a line or between marks.
MAX_KEY, MAX_LINE = 1 << 16, 1 << 10
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]+)-----")
PEM_HEADER = re.compile(r"^[A-Za-z0-9-]+:.*$", re.MULTILINE)
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}={0,2}")
LINE = re.compile(r"[ \t]*\r?\n[ \t]*([A-Za-z0-9+/]+={0,2})(?![A-Za-z0-9+/=_-])")
ANY_HEX = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){24,}(?![0-9A-Fa-f])")
#: What a text with any span has (RE2); the rest needs no further look.
PREFILTER = r"""(?i:(?:password|passwd|secret|token|api_?key)["']? *[:=])|AKIA[A-Z0-9]{16}|[0-9A-Fa-f]{24}|[A-Za-z0-9+/_-]{40}|[A-Za-z0-9_-]{8}\.[A-Za-z0-9_-]{4}[A-Za-z0-9_-]*\.|-----BEGIN """


def base_spans(text: str) -> list[Span]:
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end(), "hex") for m in HEX.finditer(text)]
    return out


def der(data: bytes) -> list | None:
    """(tag, content or children) of each element if the nested lengths add up exactly, at any depth, else None."""
    top: list = []
    at, open_ = 0, [(len(data), top)]
    while open_:
        end, inside = open_[-1]
        if at == end:
            open_.pop()
            continue
        if at + 2 > end:
            return None
        tag, n, at = data[at], data[at + 1], at + 2
        if n & 0x80:
            width = n & 0x7F
            if not 1 <= width <= 4 or at + width > end:
                return None
            n, at = int.from_bytes(data[at : at + width], "big"), at + width
        if at + n > end:
            return None
        if tag & 0x20:
            children: list = []
            inside.append((tag, children))
            open_.append((at + n, children))
        else:
            inside.append((tag, data[at : at + n]))
            at += n
    return top


SEQUENCE, INTEGER, BITS, OCTETS, OBJECT_ID = 0x30, 0x02, 0x03, 0x04, 0x06
#: Object ids of algorithms (RSA, DSA, elliptic curves) and of those whose keys are bytes of one length; those of encryption by a password begin alike.
RSA, DSA, CURVE = bytes.fromhex("2a864886f70d010101"), bytes.fromhex("2a8648ce380401"), bytes.fromhex("2a8648ce3d0201")
RAW_KEYS = {bytes.fromhex("2b656e"): 32, bytes.fromhex("2b656f"): 56, bytes.fromhex("2b6570"): 32, bytes.fromhex("2b6571"): 57}
PASSWORD_BASED = bytes.fromhex("2a864886f70d01")


def _fields(data: bytes) -> list | None:
    """The fields of bytes that are one DER sequence of some."""
    top = der(data) if data[:1] == b"\x30" else None
    return top[0][1] if top and len(top) == 1 and isinstance(top[0][1], list) and top[0][1] else None


def _private_fields(parts: list) -> bytes | None:
    """The algorithm of a private key in a form of its own."""
    tags = [t for t, _ in parts]
    if tags[:9] == [INTEGER] * 9 and set(tags[9:]) <= {SEQUENCE} and parts[0][1] in (b"\0", b"\1"):
        return RSA
    if tags == [INTEGER] * 6 and parts[0][1] == b"\0":
        return DSA
    if tags[:2] == [INTEGER, OCTETS] and parts[0][1] == b"\1" and 16 <= len(parts[1][1]) <= 72 and set(tags[2:]) <= {0xA0, 0xA1}:
        return CURVE
    return None


def _algorithm(fields: list) -> bytes | None:
    """The object id that a sequence of an algorithm begins with."""
    return fields[0][1] if isinstance(fields, list) and fields and fields[0][0] == OBJECT_ID and len(fields[0][1]) >= 3 else None


def _is_inner_private(name: bytes, inner: bytes) -> bool:
    """Whether the octets of PKCS#8 are a key of the algorithm; of an unknown one any known form counts."""
    if name in RAW_KEYS or inner[:1] == b"\x04" and name not in (RSA, DSA, CURVE):
        top = der(inner)
        return bool(top) and len(top) == 1 and top[0][0] == OCTETS and len(top[0][1]) in ({RAW_KEYS[name]} if name in RAW_KEYS else set(RAW_KEYS.values()))
    if inner[:1] == b"\x02":
        top = der(inner)
        return name == DSA and bool(top) and len(top) == 1 and len(top[0][1]) >= 16
    parts = _fields(inner)
    found = _private_fields(parts) if parts else None
    return found is not None and (found == name or name not in (RSA, DSA, CURVE))


def _is_inner_public(name: bytes, bits: bytes) -> bool:
    """Whether the bits of a public key are one of the algorithm; of an unknown one they must be a known form."""
    if len(bits) < 17 or bits[0]:
        return False
    key = bits[1:]
    if name in RAW_KEYS:
        return len(key) == RAW_KEYS[name]
    if name == CURVE:
        return len(key) % 2 == 1 and (key[0] == 4 and len(key) >= 41 or key[0] in (2, 3) and 21 <= len(key) <= 67)
    if name == DSA:
        top = der(key)
        return key[0] == INTEGER and bool(top) and len(top) == 1
    parts = _fields(key)
    return bool(parts) and [t for t, _ in parts] == [INTEGER, INTEGER] and len(parts[0][1]) >= 32 and len(parts[1][1]) <= 8 and parts[1][1][-1:] != b"" and parts[1][1][-1] % 2 == 1


def key_kind(data: bytes) -> str | None:
    """private_key, public_key or ssh_key if the bytes are the encoding of one, or the marks and lines of one encoded once more."""
    if data.startswith(b"openssh-key-v1\0"):
        return "ssh_key" if len(ssh_fields(data[15:], 3)) == 3 else None
    if data[:4] == b"\0\0\0\x07" and data[4:8] == b"ssh-" or data[:4] == b"\0\0\0\x0b" and data[4:8] == b"ssh-":
        return "ssh_key" if len(ssh_fields(data, 2)) == 2 else None
    if data.startswith(b"-----BEGIN "):
        return next((kind for *_, label, body in pem_blocks(data.decode("latin-1")) if (kind := pem_kind(label, body, nested=True))), None)
    if not (parts := _fields(data)):
        return None
    tags = [t for t, _ in parts]
    if tags[:3] == [INTEGER, SEQUENCE, OCTETS] and parts[0][1] in (b"\0", b"\1"):  # PKCS#8
        name = _algorithm(parts[1][1])
        return "private_key" if name and _is_inner_private(name, parts[2][1]) else None
    if _private_fields(parts):
        return "private_key"
    if tags == [SEQUENCE, OCTETS]:  # PKCS#8, encrypted
        name, body = _algorithm(parts[0][1]), parts[1][1]
        return "private_key" if name and name.startswith(PASSWORD_BASED) and len(body) >= 16 and len(body) % 8 == 0 else None
    if tags == [SEQUENCE, BITS]:
        name = _algorithm(parts[0][1])
        return "public_key" if name and _is_inner_public(name, parts[1][1]) else None
    return None


def ssh_fields(data: bytes, want: int) -> list[bytes]:
    """The first length-prefixed fields; fewer than wanted if a length runs over the end."""
    out, at = [], 0
    while len(out) < want and at + 4 <= len(data):
        n = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + n > len(data):
            break
        out.append(data[at + 4 : at + 4 + n])
        at += 4 + n
    return out


def unbase64(text: str) -> bytes:
    """Either alphabet, padded or not; empty if it isn't base64."""
    clean = "".join(text.split()).rstrip("=").replace("-", "+").replace("_", "/")
    if len(clean) % 4 == 1:
        return b""
    try:
        return base64.b64decode(clean + "=" * (-len(clean) % 4), validate=True)
    except (binascii.Error, ValueError):
        return b""


def is_signed_token(token: str) -> bool:
    try:
        header, payload = (json.loads(unbase64(part)) for part in token.split(".")[:2])
    except (ValueError, UnicodeDecodeError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str) and isinstance(payload, dict)


def pem_blocks(text: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, label, body) of what stands between marks of one label; line ends may be written as escapes."""
    for m in PEM.finditer(text):
        mark = f"-----END {m[1]}-----"
        at = text.find("-----", m.end())
        if at >= 0 and text.startswith(mark, at):
            yield m.start(), at + len(mark), m[1], text[m.end() : at].replace("\\r", "").replace("\\n", "\n")


def pem_kind(label: str, body: str, nested: bool = False) -> str | None:
    headers = PEM_HEADER.findall(body)
    data = unbase64(PEM_HEADER.sub("", body))
    if any(h.startswith("DEK-Info:") for h in headers):
        # enciphered as a whole: only its length can be confirmed
        return "private_key" if label.endswith("PRIVATE KEY") and data and len(data) % 8 == 0 else None
    return None if nested and data.startswith(b"-----BEGIN ") else key_kind(data)


def object_start(data: bytes) -> int:
    """Where a JSON object that the bytes end with has to begin, -1 if nowhere: behind its end no string is open, so its marks can be read backwards."""
    depth, inside = 0, False
    for m in reversed(list(JSON_MARK.finditer(data))):
        mark = m[0][-1:]
        if mark == b'"':
            inside ^= len(m[0]) % 2 == 1  # behind an odd number of backslashes it is a character
        elif not inside:
            depth += 1 if mark in b"}]" else -1
            if depth <= 0:
                return m.start() if depth == 0 and mark == b"{" else -1
    return -1


def token_spans(text: str) -> Iterator[tuple[int, int]]:
    """Signed tokens, their headers of any length; of headers that could begin at several places of a word the first that is one counts.

    A word's places whose distances from the dot are equal modulo 4 decode to ends of the same bytes, of which one at most is an
    object, so the time is that of three decodings of each word.
    """
    done, places = 0, [m.start() for m in HEADER.finditer(text)]
    at = 0
    while at < len(places):
        stop = WORD.match(text, places[at]).end()
        until = bisect_left(places, stop, at)
        starts, at = places[at:until], until
        if not text.startswith(".", stop) or not (rest := TOKEN_REST.match(text, stop)):
            continue
        # in the order of the text, the first of each distance modulo 4 has all others of it behind
        first: dict[int, int] = {}
        for p in starts:
            if p >= done and stop - p >= 8:
                first.setdefault((stop - p) % 4, p)
        found, known = [], set(starts)
        for p in first.values():
            offset = object_start(unbase64(text[p:stop]))
            start = p + offset // 3 * 4
            if offset >= 0 and offset % 3 == 0 and start in known and stop - start >= 8:
                found.append(start)
        for start in sorted(found):
            if is_signed_token(text[start : rest.end()]):
                yield start, rest.end()
                done = rest.end()
                break


def base64_length(first: str) -> int:
    """Characters of the base64 that begins so: by its DER length, none if it begins no key, or ``MAX_KEY`` where only its end tells."""
    if first.startswith(("b3BlbnNzaC1rZXktdjE", "LS0tLS1CRUdJTi")):
        return MAX_KEY
    head = unbase64(first[:12])
    if head[:1] != b"\x30":
        return 0
    width = head[1] & 0x7F if head[1] & 0x80 else 0
    if width > 4:
        return 0
    size = 2 + width + (int.from_bytes(head[2 : 2 + width], "big") if width else head[1])
    return -(-size * 4 // 3) if size * 4 // 3 < MAX_KEY else 0


def wrapped(text: str, m: re.Match) -> Iterator[tuple[int, str]]:
    """(end, base64) of a candidate with the lines behind it that its length takes in, all but the last of one length; then of itself alone."""
    wide, length = len(m.group()), base64_length(m.group())
    parts, size, at, last = [m.group()], wide, m.end(), 0
    while size < length and wide <= MAX_LINE and (line := LINE.match(text, at)) and len(line[1]) <= wide:
        parts.append(line[1])
        size, last, at = size + len(line[1].rstrip("=")), at, line.end()
        if len(line[1]) < wide or line[1].endswith("="):
            break
    if len(parts) > 1:
        yield at, "".join(parts)
        if len(parts) > 2 and length == MAX_KEY:  # the last line may be a word behind the key
            yield last, "".join(parts[:-1])
    yield m.end(), m.group()


def confirmed_spans(text: str) -> list[Span]:
    """Candidates that decode and parse."""
    out: list[Span] = []
    add = lambda start, end, kind: out.append((start, RANK[kind], end, kind))
    for start, end in token_spans(text):
        add(start, end, "signed_token")
    blocks = []
    for start, end, label, body in pem_blocks(text):
        if kind := pem_kind(label, body):
            add(start, end, kind)
            blocks.append((start, end))
    done = 0
    for m in BASE64.finditer(text):
        k = bisect_right(blocks, (m.start(), len(text))) - 1
        if m.start() < done or k >= 0 and m.start() < blocks[k][1]:
            continue
        for end, encoded in wrapped(text, m):
            if kind := key_kind(unbase64(encoded)):
                add(m.start(), end, kind)
                done = end
                break
    for m in ANY_HEX.finditer(text):
        if kind := key_kind(bytes.fromhex(m.group())):
            add(*m.span(), kind)
    return out


ROWS = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("found", pa.list_(SPAN_TYPE))])


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, counts of the base kinds, base_sha256, spans as text and found as an array.

    A null text is empty and has no spans; repeated rows give repeated results; spans of different kinds may
    overlap; an empty table gives none.  Whole texts are read, in time that grows with their length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = (0, 0, 0, sha256([]), "", [])
        for b in slices(batches):
            out = [nothing] * b.num_rows
            likely = pc.indices_nonzero(pc.fill_null(pc.match_substring_regex(b.column("text"), PREFILTER), False))
            for i, text in zip(likely.to_pylist(), strings(b.column("text").take(likely)), strict=True):
                base = base_spans(text)
                spans = base + confirmed_spans(text)
                if spans:
                    n = [sum(s[1] == k for s in base) for k in range(3)]
                    out[i] = (*n, sha256(base), joined(spans), as_dicts(spans))
            yield batch(ROWS, [b.column("doc_id"), *map(list, zip(*out, strict=True))] if out else [[]] * len(ROWS))

    return id_and_text(docs, id_col, text_col).mapInArrow(run, f"doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, found array<{SPAN_SQL}>")


def redact_secrets(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", mark: str = "[SECRET]") -> DataFrame:
    """docs with each secret's span replaced by ``mark`` (overlapping ones by one) and their length set anew.

    Rows without secrets, and null texts, stay as they are; so do all other columns.
    """
    plain, text_col = numbered(docs), place(docs, text_col)
    length_col = place(docs, length_col) if length_col and length_col.lower() in map(str.lower, docs.columns) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            at = b.schema.get_field_index(text_col)
            likely = pc.indices_nonzero(pc.fill_null(pc.match_substring_regex(b.column(at), PREFILTER), False)).to_pylist()
            if not likely:
                yield b
                continue
            texts, changed = b.column(at).to_pylist(), []
            for i in likely:
                parts, done, spans = [], 0, sorted(base_spans(texts[i]) + confirmed_spans(texts[i]))
                if spans:
                    changed.append(i)
                for start, _, end, _ in spans:
                    if start >= done:
                        parts += [texts[i][done:start], mark]
                    done = max(done, end)
                texts[i] = "".join([*parts, texts[i][done:]])
            column = pa.array(texts, b.schema.field(at).type)
            b = b.set_column(at, b.schema.field(at), column)
            k = b.schema.get_field_index(length_col) if length_col else -1
            if k >= 0:
                field = b.schema.field(k)
                touched = pa.array(np.isin(np.arange(b.num_rows), changed))
                b = b.set_column(k, field, pc.if_else(touched, pc.utf8_length(column).cast(field.type), b.column(k)))
            yield b

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
