"""Secrets: pattern matches, and encoded keys and signed tokens confirmed by their structure.

Base kinds are found by pattern alone: ``assign`` (a credential assigned to a name), ``access`` (cloud access key ids)
and ``hex`` (long lower-case hex). The other kinds are candidates in base64 or hex that are decoded
and parsed before they are reported: ``der`` (ASN.1 keys whose nested lengths fit to the byte:
PKCS#1, PKCS#8, SEC 1, encrypted PKCS#8), ``openssh`` (the length-prefixed fields of an OpenSSH private key),
``pem`` (a key under PEM's own encryption: its header fields, and a body of whole cipher blocks)
and ``jwt`` (a token whose header and claims are JSON objects and whose signature has its algorithm's length).
A key is found wherever it starts in a run of base64 or hex: its own outer length tells where it ends. Lines
of base64 are joined, whether they are parted by line ends or by escaped ones."""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect
from collections.abc import Iterator
from itertools import accumulate

from pyspark.sql import DataFrame

from tidemark.llm.common import column_list, lean, pick

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "der", "openssh", "jwt", "pem")
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40}PRIVATE KEY)-----((?:[^-]++|-(?!----))*+)-----END \1-----")
JWT = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]*)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)(?![A-Za-z0-9_-])")
#: Runs that may hold an encoded key: base64 in one alphabet or the other, over one line or more, or hex of any case.
BASE64_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}(?:(?:\r?\n[ \t]*|(?:\\r)?\\n)[A-Za-z0-9+/_-]{4,})*={0,2}")
BREAK = re.compile(r"\r?\n[ \t]*|(?:\\r)?\\n")
HEX_RUN = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{64,}")
#: How keys start: DER sequences in base64 and hex, and the magic of OpenSSH's.
BASE64_START, HEX_START = re.compile(r"M[A-P]|b3BlbnNzaC1rZXktdjE"), re.compile(r"(?=30|6f70656e7373682d6b65792d7631)", re.IGNORECASE)
#: Bytes of a key at most, where it is not alone in its run (an RSA key of 16,384 bits has some 10,000).
MOST_KEY = 1 << 16
#: Block lengths in bytes of ciphers that PEM headers name, by the start of the name.
CIPHER_BLOCKS = {"AES-": 16, "CAMELLIA-": 16, "ARIA-": 16, "SEED-": 16, "DES-": 8, "BF-": 8, "CAST5-": 8, "RC2-": 8, "IDEA-": 8}
#: The content octets of object identifiers of public-key algorithms, as hex, and bytes of signatures by algorithm.
KEY_ALGORITHMS = {
    "2a864886f70d010101": "rsa",
    "2a8648ce3d0201": "ec",
    "2a8648ce380401": "dsa",
    "2b656e": "x25519",
    "2b656f": "x448",
    "2b6570": "ed25519",
    "2b6571": "ed448",
    "2a864886f70d01050d": "pbes2",
}
SIGNATURES = {"HS256": (32,), "HS384": (48,), "HS512": (64,), "ES256": (64,), "ES384": (96,), "ES512": (132,), "EdDSA": (64, 114)}
RSA_SIGNATURE = (128, 192, 256, 384, 512, 1024)


def element(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, start of content, end of content) of the DER element at ``at``; None unless it lies within ``end``."""
    if at + 2 > end:
        return None
    tag, n = data[at], data[at + 1]
    at += 2
    if n >= 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or at + k > end or data[at] == 0:
            return None
        n = int.from_bytes(data[at : at + k], "big")
        if n < 0x80:
            return None
        at += k
    return (tag, at, at + n) if at + n <= end else None


def children(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """The elements that fill start to end to the byte, or None."""
    found = []
    while start < end:
        one = element(data, start, end)
        if one is None:
            return None
        found.append(one)
        start = one[2]
    return found


def der_key(data: bytes) -> bool:
    """Whether the bytes are one private key in DER, its nested lengths right throughout."""
    top = element(data, 0, len(data))
    if not top or top[0] != 0x30 or top[2] != len(data):
        return False
    parts = children(data, top[1], top[2])
    if not parts or len(parts) < 2:
        return False
    tags = [p[0] for p in parts]
    value = lambda p: data[p[1] : p[2]]
    if tags[0] == 0x30 and tags[1:] == [0x04]:  # encrypted PKCS#8
        inner = children(data, *parts[0][1:])
        return bool(inner) and inner[0][0] == 0x06 and value(inner[0]).hex() in KEY_ALGORITHMS
    if tags[0] != 0x02 or parts[0][2] - parts[0][1] != 1 or data[parts[0][1]] > 1:
        return False
    if len(parts) in (9, 10) and all(t == 0x02 for t in tags[:9]):  # PKCS#1: version, n, e, d, p, q, dp, dq, qinv
        n, e, p, q = (int.from_bytes(value(parts[i]), "big") for i in (1, 2, 4, 5))
        return n.bit_length() >= 256 and e >= 3 and p * q == n
    if len(parts) >= 3 and tags[1] == 0x30 and tags[2] == 0x04:  # PKCS#8: version, algorithm, key
        inner = children(data, *parts[1][1:])
        return bool(inner) and inner[0][0] == 0x06 and value(inner[0]).hex() in KEY_ALGORITHMS and parts[2][2] > parts[2][1]
    if tags[1] == 0x04 and data[parts[0][1]] == 1 and 16 <= parts[1][2] - parts[1][1] <= 72:  # SEC 1: version 1, key, [0] curve, [1] point
        rest = tags[2:]
        return bool(rest) and rest[0] in (0xA0, 0xA1) and all(t in (0xA0, 0xA1) and children(data, *p[1:]) is not None for t, p in zip(rest, parts[2:], strict=True))
    return False


def openssh_end(data: bytes) -> int | None:
    """Where the OpenSSH private key that the bytes start with ends: magic, then length-prefixed fields; None if they are none."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return None
    at, names = len(magic), []

    def field() -> bytes | None:
        nonlocal at
        if at + 4 > len(data):
            return None
        n = int.from_bytes(data[at : at + 4], "big")
        at += 4 + n
        return data[at - n : at] if at <= len(data) else None

    for _ in range(3):  # cipher, kdf, options
        names.append(field())
    if None in names or not names[0] or at + 4 > len(data):
        return None
    keys = int.from_bytes(data[at : at + 4], "big")
    at += 4
    if not 1 <= keys <= 16:
        return None
    return at if all(field() is not None for _ in range(keys)) and field() else None


def openssh_key(data: bytes) -> bool:
    """Whether the bytes are an OpenSSH private key and nothing more."""
    end = openssh_end(data)
    return end is not None and not data[end:].strip(b"\0\n")


def der_end(head: bytes) -> int | None:
    """Where the DER sequence that the bytes start with ends, if it starts as private keys do: with a version or an algorithm."""
    if len(head) < 6 or head[0] != 0x30:
        return None
    k = head[1] & 0x7F if head[1] >= 0x80 else 0
    if k > 4 or len(head) < 5 + k or (head[1] >= 0x80 and not k):
        return None
    n = int.from_bytes(head[2 : 2 + k], "big") if k else head[1]
    body = head[2 + k :]
    return 2 + k + n if body[0] == 0x30 or (body[:2] == b"\x02\x01" and body[2] <= 1) else None


def keys_in(run: str, starts: re.Pattern, read, chars) -> Iterator[tuple[int, int, str]]:
    """(start, end, kind) of the keys encoded in a run. ``read``: the run's characters as bytes; ``chars``: how many characters so many bytes take."""
    done = 0
    for m in starts.finditer(run):
        i = m.start()
        if i < done:
            continue
        head = read(run[i : i + chars(12)]) or b""
        n = der_end(head)
        if n is None and head.startswith(b"openssh-key"):
            n = openssh_end(read(run[i : i + chars(MOST_KEY) // 12 * 12]) or b"")
        if n is None or (n > MOST_KEY and i + chars(n) < len(run.rstrip("="))):
            continue
        end = i + chars(n)
        kind = structure((read(run[i:end]) or b"")[:n]) if end <= len(run) else None
        if kind:
            while end < len(run) and run[end] == "=" and (end - i) % 4:
                end += 1
            done = end
            yield i, end, kind


def encrypted_body(text: str) -> bool:
    """Whether a PEM body has the header fields of PEM's own encryption and, behind them, whole blocks of its cipher."""
    fields, body = {}, []
    for x in text.strip().splitlines():
        name, colon, value = x.partition(":")
        if colon:
            fields[name.strip()] = value.strip()
        else:
            body.append(x)
    cipher, _, vector = fields.get("DEK-Info", "").partition(",")
    block = next((n for start, n in CIPHER_BLOCKS.items() if cipher.startswith(start)), None)
    data = decoded("".join("".join(body).split()))
    if block is None or "ENCRYPTED" not in fields.get("Proc-Type", "") or not data:
        return False
    return bool(re.fullmatch(r"[0-9A-Fa-f]+", vector)) and len(vector) == 2 * block and len(data) >= 24 and len(data) % block == 0


def decoded(run: str) -> bytes | None:
    """The bytes of a base64 run in either alphabet, with or without padding."""
    plain = run.rstrip("=").translate(str.maketrans("-_", "+/"))
    if len(plain) % 4 == 1:
        return None
    try:
        return base64.b64decode(plain + "=" * (-len(plain) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def unhexed(run: str) -> bytes:
    return bytes.fromhex(run[: len(run) // 2 * 2])


def structure(data: bytes | None) -> str | None:
    """The kind of secret that the bytes are, if they are one."""
    if not data or len(data) < 24:
        return None
    if openssh_key(data):
        return "openssh"
    return "der" if data[0] == 0x30 and der_key(data) else None


def signed_token(header: str, claims: str, signature: str) -> bool:
    """Whether header and claims decode to JSON objects and the signature's length is that of the header's algorithm."""
    try:
        head, body = (json.loads(decoded(x) or b"") for x in (header, claims))
    except (ValueError, RecursionError):
        return False
    if not isinstance(head, dict) or not isinstance(body, dict) or not isinstance(head.get("alg"), str):
        return False
    sign = decoded(signature) if signature else b""
    alg = head["alg"]
    if sign is None or alg.lower() == "none":
        return sign == b""
    if alg[:2] in ("RS", "PS"):
        return len(sign) in RSA_SIGNATURE
    return len(sign) in SIGNATURES[alg] if alg in SIGNATURES else len(sign) >= 16


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the matches by pattern, in order of start and then kind."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def confirmed_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of what decoding and parsing confirms. A PEM block is reported from its first to its last dash; keys in it
    and in tokens aren't reported again."""
    found = []
    if "-----BEGIN " in text:
        for m in PEM.finditer(text):
            body = m[2].replace("\\r", "").replace("\\n", "\n").replace("\\/", "/")
            plain = "".join(x for x in body.split("\n") if ":" not in x)
            if kind := structure(decoded("".join(plain.split()))) or ("pem" if encrypted_body(body) else None):
                found.append((m.start(), m.end(), kind))
    if "eyJ" in text:
        found += [(*m.span(), "jwt") for m in JWT.finditer(text) if signed_token(*m.groups())]
    taken = sorted(found)
    starts, reach = [a for a, _, _ in taken], list(accumulate((b for _, b, _ in taken), max))
    for m in BASE64_RUN.finditer(text):
        run, places = m[0], [(0, m.start())]  # where the joined lines stand in the text
        if not run.isalnum() and BREAK.search(run):
            lines, at = [], 0
            for x in BREAK.finditer(run):
                lines.append(run[at : x.start()])
                at = x.end()
                places.append((sum(map(len, lines[-1:])) + places[-1][0], m.start() + at))
            run = "".join([*lines, run[at:]])
        for a, b, kind in keys_in(run, BASE64_START, decoded, lambda n: (4 * n + 2) // 3):
            a, b = (i - joined + place for i in (a, b - 1) for joined, place in (places[bisect(places, (i, len(text))) - 1],))
            found.append((a, b + 1, kind))
    for m in HEX_RUN.finditer(text):
        found += [(m.start() + a, m.start() + b, kind) for a, b, kind in keys_in(m[0], HEX_START, unhexed, lambda n: 2 * n)]
    inside = lambda a, b: bool(k := bisect(starts, a)) and b <= reach[k - 1]
    return sorted({*taken, *(s for s in found[len(taken) :] if not inside(s[0], s[1]))}, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Per row: counts of the base kinds, sha256 of their spans, all spans, and n_confirmed (those that parsing added).

    Spans are in code points, the end exclusive. A null text is an empty one: no spans. Whole texts are
    scanned, and work is linear in their length. Spans that start alike are in the order of their kinds, then of their ends. Repeated
    rows stay repeated. An empty table gives an empty one."""
    import pyarrow as pa

    plain = pick(docs, doc_id, text).toDF("doc_id", "text")
    kind = plain.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        for b in batches:
            counts, digests, spans, added = {k: [] for k in KINDS[:3]}, [], [], []
            for t in column_list(b, "text"):
                base, more = base_spans(t or ""), confirmed_spans(t or "")
                for k, n in counts.items():
                    n.append(sum(1 for s in base if s[2] == k))
                digests.append(hashlib.sha256(listed(base).encode()).hexdigest())
                spans.append(listed(sorted({*base, *more}, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))))
                added.append(len(more))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(counts[k], pa.int64()) for k in KINDS[:3]), pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(added, pa.int64())], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_confirmed"])

    return plain.mapInArrow(lean(run), f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_confirmed long")
