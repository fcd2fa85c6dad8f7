"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs and their spelled forms, schemes, plus signs, digits and
identifier cues. At each anchor a deterministic local parser expands to the left and right and validates what it finds.
Every parser moves forward only, so a text takes time in proportion to its length, whatever it holds.

Anchors are looked up in a lower-case copy of the same length, so cues and spelled forms count in any case.

Base kinds: email, ip, card, phone. Added: ``account`` (IBAN by its check digits, behind a cue or by its own form; numbers,
tokens and keys after a cue: with four digits, or after a colon or equals sign with one, or none for a secret) and ``url`` (a web address of a valid host that carries credentials or a query naming a person or a secret); spelled at-signs and ``mailto:`` / ``tel:`` add to
email and phone. An added span that overlaps a base span is dropped, so base spans never change.

Edge cases: a null text is empty and has no spans; each row is judged by itself, so repeated rows give equal results;
an empty table gives an empty result; in ``redacted`` further columns pass through, overlapping spans are replaced
together by the first one's mark, and a null text stays null; spans that begin together go in the order of the kinds; parsers
have no bound on lengths and read very long texts whole; other columns, whatever their names, are not read by ``found``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tactus.llm.common import no_null, table

KINDS = ("email", "ip", "card", "phone", "account", "url")
BASE = 4
_ORDER = {k: i for i, k in enumerate(KINDS)}

Span = tuple[int, str, int]  # start, kind, end

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_GROUPED = re.compile(r"[0-9](?:[ -]?[0-9])*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_RUN = re.compile(r"[0-9]++")

#: Cues that announce an identifier, in lower case.
CUES = ("account no", "account number", "account:", "acct", "iban", "kontonummer", "numéro de compte", "cuenta", "ssn", "social security", "passport", "api key", "api_key", "apikey", "password", "token", "secret")
_SPELLED = ("[at]", "(at)", "{at}", " at ")
_DOT = re.compile(r"(?: ?[\[({]dot[\])}] ?| dot |\.)", re.I)
_LABEL = re.compile(r"[A-Za-z0-9-]++")
_LEAD = re.compile(r"(?:[ \t]*(?:no\.?|number|is|nr\.?))?[ \t]*[:=#]?[ \t]*[\"']?", re.I)
#: Cues whose value may be of letters alone.
SECRETS = ("api key", "api_key", "apikey", "password", "token", "secret")
_SECRET = re.compile(r"[^\s\"'<>]{6,}+")
_VALUE = re.compile(r"[A-Za-z0-9][A-Za-z0-9_./+-]{5,}+")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{1,4}){3,8}", re.I | re.A)
#: Without a cue: in groups of four or in one piece.
_BARE = re.compile(r"[A-Z]{2}[0-9]{2}(?:(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?|[A-Z0-9]{11,30})(?![A-Z0-9])", re.I | re.A)
_TEL = re.compile(r"[0-9][ ().0-9-]+[0-9]")
#: What follows a scheme: credentials, a host of labels, a port, and the rest up to white space, quotes or brackets.
_ADDRESS = re.compile(r"(?:(?P<user>[^\s/@:?#]++:[^\s/@]*+)@)?[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+(?::[0-9]{1,5}+)?(?P<rest>(?:[/?#][^\s\"'<>]*+)?)")
_PRIVATE = re.compile(r"[?&;](?:access_|auth_|api_?)?(?:token|key|password|passwd|pwd|secret|ssn|email|e-mail|phone|user|username|session|sid)=[^&;#]", re.I)
_SCHEME = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+.-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def iban(text: str) -> bool:
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def iban_end(text: str, found: re.Match[str] | None) -> int:
    """Where an IBAN ends that begins with the match: the longest whole words of it with right check digits; else 0."""
    if found:
        for end in range(found.end(), found.start() + 14, -1):
            if not text[end : end + 1].isalnum() and text[end - 1] != " " and iban(text[found.start() : end]):
                return end
    return 0


def folded(text: str) -> str:
    """The text in lower case, character by character where that would change its length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join([x if len(x := c.lower()) == 1 else c for c in text])


def _digits(text: str) -> str:
    return "".join(_RUN.findall(text))


class Finder:
    """The automaton and what each anchor starts."""

    def __init__(self):
        import ahocorasick

        self.anchors = ahocorasick.Automaton()
        words = {str(d): "digit" for d in range(10)} | {"@": "at", "+": "plus", "://": "scheme", "mailto:": "mailto", "tel:": "tel"} | dict.fromkeys(_SPELLED, "spelled")
        words |= dict.fromkeys(CUES, "cue")
        for word, kind in words.items():
            self.anchors.add_word(word, (kind, len(word)))
        self.anchors.make_automaton()

    def spans(self, text: str) -> tuple[list[Span], list[Span]]:
        """The base spans, and all spans, each by start and kind."""
        base: list[Span] = []
        more: list[Span] = []
        email_end = dotted_end = grouped_end = 0
        for last, (kind, length) in self.anchors.iter(folded(text)):
            if kind == "digit":
                if last > 1 and text[last - 1].isalpha():
                    self._bare(text, last - 2, more)
                if last >= dotted_end:
                    dotted_end = _DOTTED.match(text, last).end()
                    if dotted_end - last >= 7:
                        self._ips(text, last, dotted_end, base)
                if last >= grouped_end:
                    grouped_end = _GROUPED.match(text, last).end()
                    if grouped_end - last >= 12:
                        digits = _digits(text[last:grouped_end])
                        if 12 <= len(digits) <= 19 and luhn(digits):
                            base.append((last, "card", grouped_end))
            elif kind == "at":
                start = last
                while start > email_end and text[start - 1] in _LOCAL:
                    start -= 1
                domain = _DOMAIN.match(text, last + 1) if start < last else None
                if domain:
                    email_end = domain.end()
                    base.append((start, "email", email_end))
            elif kind == "plus":
                found = _PHONE.match(text, last)
                if found and 9 <= len(_digits(found[0])) <= 15:
                    base.append((last, "phone", found.end()))
            else:
                getattr(self, f"_{kind}")(text, last + 1 - length, last + 1, more)
        base.sort(key=lambda s: (s[0], _ORDER[s[1]]))
        return base, self._with(base, more) if more else base

    @staticmethod
    def _ips(text: str, start: int, end: int, out: list[Span]) -> None:
        """Every four numbers of a dotted chain in turn."""
        runs = [(start + m.start(), start + m.end()) for m in _RUN.finditer(text[start:end])]
        for i in range(0, len(runs) - 3, 4):
            parts = [text[a:b].lstrip("0") for a, b in runs[i : i + 4]]
            if all(len(p) < 3 or len(p) == 3 and p <= "255" for p in parts):
                out.append((runs[i][0], "ip", runs[i + 3][1]))

    @staticmethod
    def _spelled(text: str, start: int, end: int, out: list[Span]) -> None:
        """``name [at] host [dot] org``; between plain words `` at `` only before a spelled dot."""
        plain = text[start] == " "
        left = start if plain else start - (text[start - 1 : start] == " ")
        first = left
        while first > 0 and text[first - 1] in _LOCAL:
            first -= 1
        at = end + (not plain and text[end : end + 1] == " ")
        label = _LABEL.match(text, at)
        dots = []
        while label:
            at = label.end()
            dot = _DOT.match(text, at)
            label = _LABEL.match(text, dot.end()) if dot else None
            if label:
                dots.append(dot[0])
        if first < left and dots and not (plain and dots[0] == "."):
            out.append((first, "email", at))

    @staticmethod
    def _mailto(text: str, start: int, end: int, out: list[Span]) -> None:
        at = end
        while at < len(text) and text[at] in _LOCAL:
            at += 1
        host = _LABEL.match(text, at + 1) if at > end and text[at : at + 1] == "@" else None
        if host:
            out.append((end, "email", host.end()))

    @staticmethod
    def _tel(text: str, start: int, end: int, out: list[Span]) -> None:
        found = _TEL.match(text, end)
        if found and 7 <= len(_digits(found[0])) <= 15:
            out.append((end, "phone", found.end()))

    @staticmethod
    def _scheme(text: str, start: int, end: int, out: list[Span]) -> None:
        """A web address with a valid host, if it carries credentials or a query that names a person or a secret."""
        first = start
        while first > 0 and text[first - 1] in _SCHEME:
            first -= 1
        found = _ADDRESS.match(text, end) if first < start else None
        if found and (found["user"] or _PRIVATE.search(found["rest"])):
            out.append((first, "url", end + len(found[0].rstrip(".,;:!?)]}"))))

    @staticmethod
    def _bare(text: str, start: int, out: list[Span]) -> None:
        """An IBAN without a cue: not inside a word, and with six digits beside its check digits."""
        if text[start - 1 : start].isalnum() and start:
            return
        end = iban_end(text, _BARE.match(text, start))
        if end and len(_digits(text[start:end])) >= 8:
            out.append((start, "account", end))

    @staticmethod
    def _cue(text: str, start: int, end: int, out: list[Span]) -> None:
        if text[start - 1 : start].isalnum():
            return
        at = _LEAD.match(text, end).end()
        code = iban_end(text, _IBAN.match(text, at))
        if code:
            out.append((at, "account", code))
            return
        value = _VALUE.match(text, at)
        least = 1 if any(c in ":=" for c in text[end - 1 : at]) else 4
        if least == 1 and folded(text[start:end]) in SECRETS:
            secret = _SECRET.match(text, at)
            stop = at + len(secret[0].rstrip(".,;:)]}")) if secret else at
            if stop - at >= 6:
                out.append((at, "account", stop))
        elif value and sum(c.isdigit() for c in value[0]) >= least:
            out.append((at, "account", value.end()))

    @staticmethod
    def _with(base: list[Span], more: list[Span]) -> list[Span]:
        """Base spans and the added ones that touch no span before them in (start, kind) order nor a base span."""
        kept, end, i = [], 0, 0
        for span in sorted(set(more), key=lambda s: (s[0], _ORDER[s[1]])):
            while i < len(base) and base[i][2] <= span[0]:
                i += 1
            if span[0] >= end and not any(b[0] < span[2] and b[2] > span[0] for b in base[i : i + 8]):
                kept.append(span)
                end = span[2]
        return sorted([*base, *kept], key=lambda s: (s[0], _ORDER[s[1]]))


_ready: list[Finder] = []


def finder() -> Finder:
    """One finder for each worker."""
    if not _ready:
        _ready.append(Finder())
    return _ready[0]


def listed(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in spans)


def found(docs: DataFrame) -> DataFrame:
    """For each (doc_id, text): the counts of the base spans of each kind, their digest, and all spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = finder().spans
        for batch in batches:
            rows = []
            for x in batch.column(1):
                base, spans = find(x.as_py())
                kinds = [s[1] for s in base]
                rows.append((*[kinds.count(k) for k in KINDS[:BASE]], hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans)))
            columns = zip(*rows) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 4 + [pa.string()] * 2))], names=names)

    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), no_null("text").alias("text")).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def masked(text: str) -> str:
    """The text with each group of overlapping spans replaced by <KIND> of its first."""
    _, spans = finder().spans(text)
    out, at, i = [], 0, 0
    while i < len(spans):
        start, kind, end = spans[i]
        while i + 1 < len(spans) and spans[i + 1][0] < end:
            i += 1
            end = max(end, spans[i][2])
        out += [text[at:start], f"<{kind.upper()}>"]
        at, i = end, i + 1
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced by marks, and n_chars, where there is one, counted anew."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([None if x is None else masked(x) for x in batch.column(at).to_pylist()], batch.schema.field(at).type)
            yield batch.set_column(at, batch.schema.field(at).name, texts)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.coalesce(F.char_length("text"), F.lit(0)).cast("long")) if "n_chars" in docs.columns else out


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return found(table(spark, sf_dir, "documents", ["doc_id", "text"]))
