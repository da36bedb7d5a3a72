"""Secret scanning: fixed token forms, and guess-cost dynamic programming.

Values in a credential context (``password: ...``) are segmented at minimum cost into
words, dates, repeats, keyboard walks and brute-force spans; the cost is the base-2
logarithm of the guesses an attacker needs. A value that costs at least ``min_bits`` is
a secret of kind ``guess``. Fixed forms (assignments, access keys, long hexadecimal runs)
are found besides.

Defined results: null text counts as empty text; texts are scanned whole; a value of any
length is costed whole, and every word, date, repeat and walk in it is tried; equal rows give
equal rows, null and repeated keys are kept as any others; of spans that start together the kind
listed first comes first; positions are code points, end exclusive; an empty table gives an empty
result; columns may have any names.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .frames import place, restore, strings, take

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
#: A name of a credential, a separator, and the value up to white space or a closing quote.
CONTEXT = re.compile(r"""(?:password|passwd|passphrase|passcode|pwd|secret|token|api[_-]?key|credentials?|auth[_-]?key|private[_-]?key)["']?[ \t]*(?:[:=]|=>)[ \t]*["']?([^\s"'<>,;]+)""", re.I | re.A)
#: Cheap filters; each lets through every text in which its pattern matches.
_MAYBE_NAMED = r"(?i)(pass|pwd|secret|token|key|credential)[^:=\n]*[:=]"
_MAYBE_ACCESS = r"AKIA[A-Z0-9]{14}"
_MAYBE_HEX = r"[0-9a-f]{16}"

#: Common words of passwords, most common first; a word's rank is its number of guesses.
WORDS = {w: i + 1 for i, w in enumerate("""password pass admin welcome login letmein monkey dragon master hello love secret
sunshine princess football baseball shadow superman batman trust freedom summer winter spring autumn flower cookie
hunter killer soccer hockey ranger computer internet server system root user guest test demo default change changeme
token key data cloud office company money power star black white blue green red orange purple silver gold diamond
tiger lion eagle wolf bear horse cat dog fish bird michael jordan daniel thomas robert charlie george andrew jessica
ashley jennifer amanda london paris berlin madrid america monday friday sunday january april may june july august
october november december one two three the and for you not with this that what correct battery staple house home
happy lucky magic angel baby ginger pepper cheese chocolate banana apple cherry coffee matrix phoenix example
placeholder sample temp temporary private public service account backup""".split())}
#: Frequent words of German, French and Spanish, which the ranked vocabulary below lacks; guessed after all of its words.
FOREIGN = """einstellungen einstellung verantwortung wissenschaft entwicklung kommunikation bedeutung verwaltung benutzer
benutzername kennwort passwort geheimnis schlüssel zugangsdaten anmeldung abmeldung datenbank verbindung konfiguration
anforderung anforderungen beschreibung verschlüsselung sicherheit unternehmen gesellschaft regierung information
informationen möglichkeit möglichkeiten zusammenhang zusammenarbeit unterstützung voraussetzung voraussetzungen
veröffentlichung bestätigung überprüfung genehmigung berechtigung berechtigungen umgebung zeichenkette erforderlich
verfügbar vertraulich persönlich öffentlich notwendig wiederherstellung aktualisierung bezeichnung dokumentation
développement informations gouvernement aujourd paramètres paramètre utilisateur utilisateurs identifiant identifiants
authentification autorisation configuration renseignements connaissance connaissances enregistrement environnement
confidentialité chiffrement vérification connexion déconnexion établissement entreprise société obligatoire nécessaire
disponible mot passe secrète réinitialisation renouvellement fonctionnement administrateur responsabilité sécurité
bibliothèque description documentation exigences communication
configuración contraseña contraseñas desarrollo información usuario usuarios identificación autenticación autorización
conocimiento administración administrador responsabilidad seguridad necesario obligatorio disponible confidencial
requisitos requerimientos comunicación documentación descripción verificación actualización restablecimiento
establecimiento funcionamiento gobierno sociedad empresa ambiente credenciales parámetros parámetro biblioteca
conexión clave secreto cifrado""".split()
_LONGEST_WORD = 40


@lru_cache(maxsize=1)
def words() -> dict[str, int]:
    """Rank of each known word: WORDS, then the whole words of a public vocabulary in its order (most frequent first), then FOREIGN."""
    import public_tokenizers

    ranks = dict(WORDS)
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken")) as file:
        for line in file:
            word = base64.b64decode(line.split()[0]).decode(errors="replace")
            if word[0] == " " and len(word) > 4 and word[1:].isalpha() and len(word) <= _LONGEST_WORD:
                ranks.setdefault(word[1:].lower(), len(ranks) + 1)
    for word in FOREIGN:
        ranks.setdefault(word, len(ranks) + 1)
    return ranks


_LEET = str.maketrans("@4301!5$7", "aaeoiisst")
_ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz")
_NEXT = {(row[i], row[i + s]) for row in _ROWS for s in (1, -1) for i in range(len(row)) if 0 <= i + s < len(row)}
_YEAR, _MONTH, _DAY, _MARK = r"(?:19|20)\d\d", r"(?:0?[1-9]|1[0-2])", r"(?:0?[1-9]|[12]\d|3[01])", r"[-/._]"
_FULL_MONTH, _FULL_DAY = r"(?:0[1-9]|1[0-2])", r"(?:0[1-9]|[12]\d|3[01])"
#: Forms of a date and the bits of one: 120 years, 366 days, and two bits for the mark between.
DATES = [
    (re.compile(form), bits)
    for form, bits in (
        (_YEAR, math.log2(120)),
        (_YEAR + _FULL_MONTH + _FULL_DAY, math.log2(120 * 366)),
        (_FULL_DAY + _FULL_MONTH + _YEAR, math.log2(120 * 366)),
        (_YEAR + f"({_MARK})" + _FULL_MONTH + r"\1" + _FULL_DAY, math.log2(120 * 366) + 2),
        (_DAY + f"({_MARK})" + _MONTH + r"\1" + _YEAR, math.log2(120 * 366) + 2),
        (_DAY + f"({_MARK})" + _MONTH + r"\1" + r"\d\d", math.log2(120 * 366) + 2),
    )
]
_SEGMENT_BITS = 1.0  # where a segment ends has to be guessed too
PERIODS = range(1, 9)  # lengths of a block that is repeated


def _brute(char: str) -> float:
    return math.log2(10 if char.isdigit() else 26 if char.isascii() and char.isalpha() else 33 if char.isascii() else 1000)


class _Value:
    """A value with what tells quickly which segments start at a place."""

    def __init__(self, value: str):
        lower = value.lower()
        self.value, self.n = value, len(value)
        self.lower = lower if len(lower) == len(value) else value
        self.plain = self.lower.translate(_LEET)
        n, low = self.n, self.lower
        self.brute = np.array([_brute(c) for c in value])
        self.brute_before = np.concatenate([[0.0], np.cumsum(self.brute)])
        codes = np.array([ord(c) for c in value])
        self.reach = {}  # of each period: how many characters from a place on are as one period later
        for period in PERIODS:
            same = np.concatenate([codes[:-period] == codes[period:], np.zeros(min(period, n), bool)])[:n] if period < n else np.zeros(n, bool)
            ends = np.where(same, n, np.arange(n))
            self.reach[period] = np.minimum.accumulate(ends[::-1])[::-1] - np.arange(n)
        steps = np.array([(low[i], low[i + 1]) in _NEXT for i in range(n - 1)] + [False], bool)
        ends = np.where(steps, n, np.arange(n))
        self.walk = np.minimum.accumulate(ends[::-1])[::-1] + 1 if n else ends  # the end of the walk that goes on from a place
        self.turns = np.cumsum([0, 0, *(low[i] == low[i - 2] for i in range(2, n))])[:n]
        self.raised = np.concatenate([[0], np.cumsum([a != b for a, b in zip(value, low, strict=True)])])

    def words(self, i: int):
        """(end, bits) of every word at ``i``."""
        known = words()
        for j in range(i + 3, min(self.n, i + _LONGEST_WORD) + 1):
            word, own = self.plain[i:j], self.lower[i:j]
            if own in known or word in known:
                ranks = [(known[w], changed) for w, changed in {own: 0, word: sum(a != b for a, b in zip(word, own, strict=True))}.items() if w in known]
                raised = sum(c.isupper() for c in self.value[i:j])
                case = 0 if not raised else 1 if raised == j - i or self.value[i].isupper() and raised == 1 else raised + 1
                yield j, case + min(math.log2(rank) + changed for rank, changed in ranks)

    def dates(self, i: int):
        for form, bits in DATES:
            if (m := form.match(self.value, i)) is not None:
                yield m.end(), bits

    def repeats(self, i: int, now: float = 0.0, leads: dict | None = None):
        """(ends, bits) of all blocks at ``i`` that come again and again, for each length of the block.

        leads: of each length and phase the last start that was tried and its cost. From a start further on in the same run the
        same end costs log2(times from there / times from here) less; where ``now`` is above by as much as that can be, at
        the nearest end, nothing is won.
        """
        for period in PERIODS:
            reach = int(self.reach[period][i])
            most, least = reach // period + 1, 3 if period == 1 else 2
            if most >= least:
                if leads is not None:
                    start, cost = leads.get((period, i % period), (-1, 0.0))
                    if start >= 0 and start + int(self.reach[period][start]) == i + reach and now >= cost + math.log2(((i - start) // period + least) / least):
                        continue
                    leads[period, i % period] = i, now
                times = np.arange(least, most + 1)
                yield i + times * period, self.brute_before[i + period] - self.brute_before[i] + np.log2(times)

    def walks(self, i: int, most: float = math.inf):
        """(ends, bits) of all runs of neighbours on a keyboard row, or in the alphabet, from ``i`` on, that turn less than ``most`` times."""
        end = int(self.walk[i])
        if most < math.inf and i + 1 < self.n:
            end = min(end, int(np.searchsorted(self.turns, self.turns[i + 1] + most)))
        ends = np.arange(i + 3, end + 1)
        if len(ends):
            yield ends, math.log2(47) + np.log2(ends - i) + self.turns[ends - 1] - self.turns[i + 1] + (self.raised[ends] > self.raised[i])


def _segments(value: str):
    """(start, end, kind, bits) of every segment but the brute-force ones."""
    v = _Value(value)
    for i in range(v.n):
        for kind, found in (("word", v.words(i)), ("date", v.dates(i))):
            yield from ((i, j, kind, bits) for j, bits in found)
        for kind, found in (("repeat", v.repeats(i)), ("walk", v.walks(i))):
            for ends, bits in found:
                yield from ((i, j, kind, b) for j, b in zip(ends.tolist(), bits.tolist(), strict=True))


@lru_cache(maxsize=20_000)
def guess_bits(value: str, enough: float = math.inf) -> float:
    """Minimum cost of ``value`` over all segmentations: best[e] for its first e characters, carried forward from each start.

    Where no segmentation of what was seen so far costs less than ``enough``, that is the answer: the rest can only add.
    A repeat that goes on from an earlier start of the same run, as cheap to every end, is not tried again, so runs
    of like characters take a pass over their ends for few of their starts.
    """
    v = _Value(value)
    best = np.full(v.n + 1, np.inf)  # the last segment is none of brute force; the start counts as one
    best[0], brute = 0.0, math.inf  # brute: the cost if the last segment is one of brute force
    leads: dict[tuple[int, int], tuple[int, float]] = {}
    # whether it is enough is asked at the first starts only, as it takes a pass over the rest each time
    for i in range(v.n):
        if i < 1000 and enough < math.inf and min(brute, float(best[i:].min())) >= enough:
            return enough
        now = min(float(best[i]), brute) + _SEGMENT_BITS
        for j, bits in (*v.words(i), *v.dates(i)):
            best[j] = min(best[j], now + bits)
        for ends, bits in (*v.repeats(i, now, leads), *v.walks(i, enough - now)):
            best[ends] = np.minimum(best[ends], now + bits)
        brute = min(brute, now) + float(v.brute[i])
    return min(float(best[v.n]), brute)


def find(text: str, min_bits: float = 40.0) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every secret in ``text``, by start, then kind as listed."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    found += [(m.start(1), m.end(1), "guess") for m in CONTEXT.finditer(text) if guess_bits(m[1], min_bits) >= min_bits]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def found_in(column: pa.Array, min_bits: float) -> list[list[tuple[int, int, str]]]:
    """``find`` for a batch; only texts that pass a filter are looked at in Python."""
    column = column.fill_null("")
    maybe = pc.match_substring_regex(column, _MAYBE_HEX)
    for pattern in (_MAYBE_ACCESS, _MAYBE_NAMED):
        maybe = pc.or_(maybe, pc.match_substring_regex(column, pattern))
    return [find(text.as_py(), min_bits) if flag else [] for text, flag in zip(column, maybe.to_pylist(), strict=True)]


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id", min_bits: float = 40.0) -> DataFrame:
    """(key, spans array<struct<start, end, kind>>) of every row."""

    def run(batches):
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
        for batch in batches:
            spans = [[dict(zip(("start", "end", "kind"), s, strict=True)) for s in found] for found in found_in(batch.column("text"), min_bits)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(spans, kind)], ["key", "spans"])

    narrow = take(docs, key=key, text=text).withColumn("text", F.col("text").cast("string"))
    return narrow.mapInArrow(run, f"key {narrow.schema['key'].dataType.simpleString()}, spans array<struct<start: bigint, end: bigint, kind: string>>").withColumnRenamed("key", key)


def listed(spans):
    """Column: spans as ``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(docs: DataFrame, min_bits: float = 40.0) -> DataFrame:
    """Counts of the fixed forms, their digest, and all spans."""
    spans = F.col("spans")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter(spans, lambda s: s["kind"] != "guess")
    return scan(docs, min_bits=min_bits).select("doc_id", *map(count, KINDS[:3]), F.sha2(listed(base), 256).alias("base_sha256"), listed(spans).alias("spans"), count("guess"))


def hidden(text: str, spans: list[tuple[int, int, str]], mark: str = "[secret]") -> str:
    """``text`` with each union of overlapping spans replaced by ``mark``."""
    out, at = [], 0
    for start, end, _ in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text: str = "text", min_bits: float = 40.0) -> DataFrame:
    """``docs`` with the secrets in its text replaced; null text stays null, other columns stay."""
    names = docs.columns
    narrow = take(docs, row="row", apart=text, text=text).withColumn("text", F.col("text").cast("string"))

    def run(batches):
        for batch in batches:
            texts = strings(batch, "text")
            made = [hidden(t, s) if s else t for t, s in zip(texts, found_in(batch.column("text"), min_bits), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.string()), batch.column("row")], ["text", "row"])

    return restore(narrow.mapInArrow(run, narrow.schema), "row", names, {place(names, text): F.col("text")})


def digest(spans: list[tuple[int, int, str]]) -> str:
    """Plain form of the digest column, for tests."""
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in spans).encode()).hexdigest()
