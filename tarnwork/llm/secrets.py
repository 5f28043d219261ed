"""Secret scans: an Aho-Corasick automaton finds keywords, anchored expressions look only there, checksums decide.

Kinds, in the order that breaks ties of place: KINDS. assign, access and hex follow the base contract. github and npm tokens
carry the CRC-32 of their first 30 characters in base 62 in the last six, which has to agree; a jwt's head has to decode to
a JSON object that names an algorithm; slack tokens and pem keys have strict shapes. A hex run has no keyword and is found by
its own expression.

Time is linear in the text, whatever it repeats: a jwt's parts and a pem key's body are runs of characters; where an attempt
failed, the others that begin in the same run would fail for the same reason and are not made.

Null text counts as empty and has no spans. Each row depends on its text alone: ties, repeated rows, rows without an id and
other columns (whatever their names) have no influence. An empty table gives an empty one. Offsets are code points, ends
exclusive. Texts are taken whole.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import json
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame

from tarnwork.llm.common import id_text, per_text, pieces

KINDS = ("assign", "access", "hex", "github", "npm", "slack", "jwt", "pem")
BASE = 3
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
#: kind -> keywords (lower case) and the expression that has to match where a keyword begins.
ANCHORED = {
    "assign": (("password", "passwd", "secret", "token", "apikey", "api_key"), ASSIGN),
    "access": (("akia",), ACCESS),
    "github": (("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), re.compile(r"gh[pousr]_[0-9A-Za-z]{36}(?![0-9A-Za-z_])")),
    "npm": (("npm_",), re.compile(r"npm_[0-9A-Za-z]{36}(?![0-9A-Za-z_])")),
    "slack": (("xoxb-", "xoxp-", "xoxa-", "xoxr-", "xoxs-"), re.compile(r"xox[bpars]-[0-9]{8,}-[0-9A-Za-z-]{10,}")),
    "jwt": (("eyj",), re.compile(r"eyJ[0-9A-Za-z_-]{8,}+\.eyJ[0-9A-Za-z_-]{8,}+\.[0-9A-Za-z_-]{16,}+")),
    "pem": (("-----begin ",), re.compile(r"-----BEGIN (?:[A-Z0-9]++ )*PRIVATE KEY-----")),  # pem_keys() finds the rest
}
JWT_RUN, PEM_RUN = re.compile(r"[0-9A-Za-z_-]+"), re.compile(r"[A-Za-z0-9+/=\s:,.-]*")
PEM_FOOT = re.compile(r"-----END (?:[A-Z0-9]++ )*PRIVATE KEY-----")


def checksum_agrees(token: str) -> bool:
    """Of a four-character prefix, 30 characters and their CRC-32 in six digits of base 62."""
    n, digits = zlib.crc32(token[4:34].encode()), ""
    for _ in range(6):
        n, k = divmod(n, 62)
        digits = BASE62[k] + digits
    return digits == token[34:]


def jwt_head(token: str) -> bool:
    head = token.split(".")[0]
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (ValueError, TypeError):
        return False


VALID = {
    "assign": lambda m: len(m[1]) >= 6,
    "access": lambda m: len(m[0]) >= 20,
    "github": lambda m: checksum_agrees(m[0]),
    "npm": lambda m: checksum_agrees(m[0]),
    "jwt": lambda m: jwt_head(m[0]),
}


@functools.cache
def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for kind, (words, _) in ANCHORED.items():
        for w in words:
            a.add_word(w, (kind, len(w) - 1))
    a.make_automaton()
    return a


def spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) in order."""
    found = [(m.start(), KINDS.index("hex"), m.end()) for m in HEX.finditer(text)]
    lower = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # ASCII letters only: places stay
    hits: dict[str, list[int]] = {}
    for last, (kind, back) in automaton().iter(lower):
        hits.setdefault(kind, []).append(last - back)
    for kind, places in hits.items():
        if kind == "pem":
            found += [(a, KINDS.index(kind), b) for a, b in pem_keys(text, sorted(places))]
            continue
        match, valid, free, k = ANCHORED[kind][1].match, VALID.get(kind), 0, KINDS.index(kind)
        for at in sorted(places):
            if at < free:
                continue
            if m := match(text, at):
                free = m.end()  # a match that fails the check still takes its text
                if not valid or valid(m):
                    found.append((at, k, free))
            elif kind == "jwt" and text.startswith("eyJ", at):
                free = JWT_RUN.match(text, at).end()
    return sorted(found)


def pem_keys(text: str, places: list[int]) -> list[tuple[int, int]]:
    """(start, end) of the keys that begin at places: a head, a body of one run of characters, the first foot in that run."""
    out, free, run = [], 0, 0
    for at in places:
        if at < free or not (head := ANCHORED["pem"][1].match(text, at)):
            continue
        body = head.end()
        if body >= run:
            run = PEM_RUN.match(text, body).end()
        if foot := PEM_FOOT.search(text, body + 1, run):
            free = foot.end()
            out.append((at, free))
        else:
            free = run
    return out


def scan(texts: list[str]) -> list[list]:
    out: list[list] = [[] for _ in range(BASE + 2)]
    for t in texts:
        found = spans(t)
        said = [f"{KINDS[k]}:{a}:{b}" for a, k, b in found]
        base = ",".join(s for s, x in zip(said, found, strict=True) if x[1] < BASE)
        for k in range(BASE):
            out[k].append(sum(x[1] == k for x in found))
        out[BASE].append(hashlib.sha256(base.encode()).hexdigest())
        out[BASE + 1].append(",".join(said))
    return out


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_assign, n_access, n_hex long, base_sha256, spans string) for each row."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    types = [pa.int64()] * BASE + [pa.string()] * 2
    return id_text(docs, id_col, text_col).mapInArrow(per_text(scan, types), schema).withColumnRenamed("id", id_col)


def redacted(text: str, mark: str = "[REDACTED]") -> str:
    out, at = [], 0
    for a, _, b in spans(text):
        if b > at:
            if a >= at:
                out += [text[at:a], mark]
            at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """All rows and columns; each run of overlapping spans in the text becomes a mark, and chars_col (if there) the new length. Null stays null."""
    recount = chars_col in docs.columns

    def run(batches):
        for batch in batches:
            for at, n in pieces(batch.column(text_col)):
                part = batch.slice(at, n)
                old = part.column(text_col).to_pylist()
                new = [t if t is None else redacted(t) for t in old]
                part = part.set_column(part.schema.get_field_index(text_col), part.schema.field(text_col), pa.array(new, part.schema.field(text_col).type))
                if recount:
                    field = part.schema.field(chars_col)
                    count = [c if a is None or a == b else len(b) for a, b, c in zip(old, new, part.column(chars_col).to_pylist(), strict=True)]
                    part = part.set_column(part.schema.get_field_index(chars_col), field, pa.array(count, field.type))
                yield part

    return docs.mapInArrow(run, docs.schema)
