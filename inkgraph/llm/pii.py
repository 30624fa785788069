"""Personal data by anchor expansion.

One Aho-Corasick pass finds the anchors of a text: at-signs, plus-signs, digits, scheme marks and
the cue words of account numbers and street addresses. A deterministic local parser expands each
anchor to its boundaries and validates it. Every parser moves strictly forward, so the work is
linear in the text whatever it holds.

Base kinds (leftmost matches that don't overlap within a kind; a match that fails its validation is
dropped and not tried again):
  email  local part, at-sign, at least two dotted labels
  ip     four dotted numbers of at most 255
  card   16 to 19 digits, single spaces or hyphens between them, passing the Luhn check
  phone  plus-sign, 8 to 15 digits with spaces, brackets, dots or hyphens between them
The method adds, and never removes:
  url     a scheme and a host with an optional user, port and path
  iban    an account number of the ISO 13616 form after a cue, passing the mod-97 check
  street  house number and street: "12 Main Oak Street", "Lange Straße 12", "12 rue de la Paix",
          "Calle de Alcalá, 12"
  secret  what is assigned to a token, key or password, or follows "Bearer": at least 12 letters, digits
          and signs, some of them digits and some letters

Defined cases: null and empty texts have no spans; texts of any length are read whole; repeated rows
repeat their result; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
ADDED = ("url", "iban", "street", "secret")
Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_RUN = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SCHEMES = ("https", "http", "ftp", "ssh", "mailto", "file")
_URL_REST = re.compile(r"(?:[A-Za-z0-9._%+~:-]+@)?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*(?::[0-9]{1,5})?(?:[/?#][^\s\"'<>]*)?")
_IBAN = re.compile(r"[\s:#.-]{0,8}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
_STREET = re.compile(r"(?<![0-9A-Za-z])[0-9]{1,5}[A-Za-z]?(?: [A-Z][\w'-]{1,30}){1,4} $")
_CUES = ("IBAN", "Iban", "iban", "account", "Account", "Konto", "konto", "compte", "Compte", "cuenta", "Cuenta")
_STREET_WORDS = ("Street", "Avenue", "Road", "Boulevard", "Lane", "Drive")
# German streets end in these words, French and Spanish ones begin with these.
_STREET_ENDS = ("straße", "strasse", "weg", "platz", "allee", "gasse", "Straße", "Weg", "Platz", "Allee", "Gasse")
_HOUSE_AFTER = re.compile(r" [0-9]{1,4}(?: ?[a-z])?(?![0-9A-Za-z])")
_WORDS_BEFORE = re.compile(r"(?<![\w-])[A-ZÄÖÜ](?:[\w.-]{0,30}|[\w.-]{0,30} )$")
_RUE_WORDS = ("rue", "avenue", "boulevard", "chemin", "quai")
_HOUSE_BEFORE = re.compile(r"(?<![0-9A-Za-z])[0-9]{1,4}(?: bis| ter)?,? $")
_RUE_NAME = re.compile(r"(?: (?:de la|de|du|des|la|le|les|aux))?(?: (?:[ld]['’])?[A-ZÀ-Ý][\w'’-]{1,30}){1,4}")
_CALLE_WORDS = ("Calle", "calle", "Avenida", "avenida", "Plaza", "Paseo")
_CALLE_NAME = re.compile(r"(?: (?:de la|de los|de las|de|del|la|las|los|el))?(?: [A-ZÁÉÍÓÚÑ][\w'-]{1,30}){1,4},? (?:n[.º°] ?)?[0-9]{1,4}(?![0-9A-Za-z])")
_SECRET_WORDS = ("token", "secret", "password", "passwd", "api_key", "apikey", "api-key", "api key", "access_key", "private_key", "bearer")
_SECRET_VALUE = re.compile(r"[\"']?(?:\s{0,4}(?:=>|:=|[:=])\s{0,4}| {1,4}(?<=earer )|(?<=EARER) )[\"']?([A-Za-z0-9_./+~=-]{12,512})")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _mod97(account: str) -> bool:
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    auto = ahocorasick.Automaton()
    auto.add_word("@", ("at", 1))
    auto.add_word("+", ("plus", 1))
    auto.add_word("://", ("scheme", 3))
    for d in "0123456789":
        auto.add_word(d, ("digit", 1))
    for w in _CUES:
        auto.add_word(w, ("cue", len(w)))
    for w in _STREET_WORDS:
        auto.add_word(" " + w, ("street", len(w)))
    for w in _STREET_ENDS:
        auto.add_word(w + " ", ("strasse", len(w) + 1))
    for w in _RUE_WORDS:
        auto.add_word(" " + w + " ", ("rue", len(w) + 1))
    for w in _CALLE_WORDS:
        auto.add_word(w + " ", ("calle", len(w) + 1))
    for w in _SECRET_WORDS:
        for form in (w, w.capitalize(), w.upper()):
            auto.add_word(form, ("secret", len(form)))
    auto.make_automaton()
    return auto


def find_spans(text: str) -> list[Span]:
    """(kind, start, end) in code points, by kind as listed and then by start."""
    out: dict[str, list[Span]] = {k: [] for k in (*BASE, *ADDED)}
    email_from = ip_from = card_from = phone_from = url_from = iban_from = street_from = secret_from = 0
    for last, (kind, size) in _automaton().iter(text):
        at = last - size + 1
        if kind == "digit":
            if at >= ip_from:
                if m := _IP.match(text, at):
                    ip_from = m.end()
                    if all(len(p) < 10 and int(p) <= 255 or int(p.lstrip("0")[:4] or 0) <= 255 for p in m[0].split(".")):
                        out["ip"].append(("ip", at, ip_from))
                else:
                    ip_from = _RUN.match(text, at).end()
            if at >= card_from:
                if m := _CARD.match(text, at):
                    card_from = m.end()
                    if 16 <= card_from - at <= 37:
                        digits = m[0].replace(" ", "").replace("-", "")
                        if 16 <= len(digits) <= 19 and luhn(digits):
                            out["card"].append(("card", at, card_from))
                else:
                    card_from = at + 1
        elif kind == "at":
            begin = at
            while begin > email_from and text[begin - 1] in _LOCAL:
                begin -= 1
            if begin < at and (m := _DOMAIN.match(text, at + 1)):
                email_from = m.end()
                out["email"].append(("email", begin, email_from))
            else:
                email_from = at + 1  # no local part reaches over an at-sign
        elif kind == "plus":
            if at >= phone_from and (m := _PHONE.match(text, at)):
                phone_from = m.end()
                if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out["phone"].append(("phone", at, phone_from))
        elif kind == "scheme":
            if at >= url_from:
                for s in _SCHEMES:
                    begin = at - len(s)
                    if begin >= url_from and text.startswith(s, begin) and (not begin or not text[begin - 1].isalnum()) and (m := _URL_REST.match(text, last + 1)):
                        url_from = begin + len((text[begin : m.end()]).rstrip(".,;:!?)"))
                        out["url"].append(("url", begin, url_from))
                        break
        elif kind == "cue":
            if last >= iban_from and (m := _IBAN.match(text, last + 1)):
                # The longest part that is a whole account: spaces and letters after it may have joined.
                for end in range(m.end(1), m.start(1) + 14, -1):
                    flat = text[m.start(1) : end].replace(" ", "")
                    if text[end - 1] != " " and 15 <= len(flat) <= 34 and _mod97(flat):
                        out["iban"].append(("iban", m.start(1), end))
                        iban_from = end
                        break
        elif kind == "secret":
            if at >= secret_from and (m := _SECRET_VALUE.match(text, last + 1)):
                begin, end = m.span(1)
                end = begin + len(m[1].rstrip(".,"))
                value = text[begin:end]
                if len(value) >= 12 and any(c.isdigit() for c in value) and any(c.isalpha() for c in value):
                    out["secret"].append(("secret", begin, end))
                    secret_from = end
        elif at < street_from:
            continue
        elif kind == "strasse":
            floor = max(street_from, at - 40)
            if (m := _HOUSE_AFTER.match(text, last)) and (text[at].isupper() or _WORDS_BEFORE.search(text[floor:at])):
                # A street word of its own may have a word before it, one within a word has the rest of it.
                b = _WORDS_BEFORE.search(text[floor:at])
                begin = floor + b.start() if b else at
                street_from = m.end()
                out["street"].append(("street", begin, street_from))
        elif kind == "rue":
            b = _HOUSE_BEFORE.search(text[max(street_from, at - 12) : at])
            if b and (m := _RUE_NAME.match(text, last)):
                begin, street_from = max(street_from, at - 12) + b.start(), m.end()
                out["street"].append(("street", begin, street_from))
        elif kind == "calle":
            if (not at or not text[at - 1].isalnum()) and (m := _CALLE_NAME.match(text, last)):
                street_from = m.end()
                out["street"].append(("street", at, street_from))
        else:
            floor = max(street_from, at - 140)
            if (last + 1 >= len(text) or not text[last + 1].isalnum()) and (m := _STREET.search(text[floor:at])):
                out["street"].append(("street", floor + m.start(), last + 1))
                street_from = last + 1
    return [s for kind in (*BASE, *ADDED) for s in out[kind]]


def join_spans(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def pii_spans(docs: DataFrame) -> DataFrame:
    """doc_id and spans (array of kind, start, end) for every row of ``docs`` (doc_id, text)."""
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"kind": k, "start": a, "end": b} for k, a, b in find_spans(t.as_py() or "")] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(kind))], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(find, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with each span of the text replaced by its kind in square brackets."""

    def hide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = []
            for cell in batch.column(at):
                text, out, done = cell.as_py(), [], 0
                for k, a, b in sorted(find_spans(text or ""), key=lambda s: (s[1], -s[2])):
                    if a >= done:
                        out += [text[done:a], f"[{k}]"]
                    done = max(done, b)
                texts.append(None if text is None else "".join(out) + text[done:])
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(hide, docs.schema)


def span_digests(found: DataFrame) -> DataFrame:
    """Counts by base kind, a digest of the base spans, all spans as a string, and counts of what was added:
    n_secret, n_account, n_street, n_url, and n_private, all kinds but plain addresses of pages."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.array_join(F.transform(F.filter("spans", lambda s: s["kind"].isin(*BASE)), one), ",")
    private = F.size(F.filter("spans", lambda s: s["kind"] != "url")).cast("long").alias("n_private")
    added = [count("secret"), count("iban").alias("n_account"), count("street"), count("url"), private]
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(base, 256).alias("base_sha256"), F.array_join(F.transform("spans", one), ",").alias("spans"), *added)
