"""Personal data by weak supervision.

Strict patterns give *base* spans (always kept). Wider patterns give further
candidates; regex, gazetteer and context labelers vote on every candidate,
expectation-maximisation over the vote patterns of **all** documents estimates
how reliable each labeler is, and the resulting soft labels train a logistic
span classifier that decides which candidates are added.

Only pattern counts reach the driver. A pattern is a kind, six votes of three
values, three small shape classes, three classes of what is inside the span and one
of 17 classes of the word before it, so their number is bounded whatever the
size of the corpus. The label model sees the votes alone, the span classifier all of it. Texts are read and scanned once; the candidates are written
to the shared folder and both later passes read those.

Edge cases: a null text counts as empty; empty texts and tables give no spans; very
long texts take time linear in their length but for sorting their candidates;
repeated rows and null ids give one output row each; only ``id_col`` and
``text_col`` are read, so further columns with any names do no harm.
"""

import bisect
import hashlib
import re
import zlib

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilespark.llm.common import per_text
from tilespark.session import materialise, ship

#: Base kinds in the order of the digest, then the added kinds.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = BASE_KINDS + ("secret", "national_id", "person")

#: Gazetteers and context words.
TOP_LEVEL = frozenset(
    "com org net edu gov mil int info biz name pro io co me tv app dev ai cloud online site shop xyz "
    "de fr es it uk us eu ch at nl be ca au jp cn in br mx ar cl pe ru ua pl cz sk hu ro bg gr tr se no dk fi ie pt lu li kr tw hk sg nz za il".split()
)
COUNTRY_CODES = tuple(
    "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 "
    "212 213 216 218 234 254 351 352 353 354 355 356 357 358 359 370 371 372 373 374 375 380 381 385 386 387 420 421 423 852 853 886 961 962 963 964 965 966 971 972 974 977 994 995 998".split()
)
GIVEN_NAMES = (
    "James John Robert Michael William David Richard Joseph Thomas Charles Christopher Daniel Matthew "
    "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Emily Anna Maria Laura "
    "Daniel Matthew Anthony Mark Donald Steven Andrew Paul Joshua Kenneth Kevin Brian George Timothy Ronald Edward Jason Jeffrey Ryan "
    "Jacob Gary Nicholas Eric Jonathan Stephen Larry Justin Scott Brandon Benjamin Samuel Gregory Alexander Patrick Frank Raymond Jack Dennis "
    "Margaret Lisa Betty Sandra Ashley Kimberly Donna Michelle Carol Amanda Dorothy Melissa Deborah Stephanie Rebecca Sharon Cynthia Kathleen "
    "Amy Angela Shirley Brenda Emma Pamela Nicole Helen Samantha Katherine Christine Rachel Carolyn Janet Catherine Heather Diane Olivia Julie "
    "Hans Klaus Jürgen Wolfgang Sabine Petra Peter Stefan Andreas Markus Ursula Monika Renate Birgit Pierre Jean Jacques Camille Michel Philippe "
    "Nathalie Isabelle Sylvie Chloé Carlos José Javier Carmen Lucía Antonio Manuel Francisco Luis Miguel Pilar Dolores Teresa Alejandro"
).split()
SECRET_WORDS = ("token", "secret", "password", "passwd", "api_key", "apikey", "api-key", "access_key", "private_key")
POSITIVE_CONTEXT = {
    "email": ("mail", "contact", "correo", "courriel", "write to", "reach"),
    "ip": ("ip", "host", "server", "addr", "login from", "connect"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "fax", "mobile", "whatsapp", "appel", "llam", "anruf"),
    "secret": SECRET_WORDS,
    "national_id": ("ssn", "social security", "national id", "passport", "dni"),
    "person": ("mr.", "mrs.", "ms.", "dr.", "name is", "herr ", "frau ", "mme ", "señor", "señora", "by "),
}
NEGATIVE_CONTEXT = ("version", "isbn", "invoice", "order no", "figure", "section", "serial", "http://", "https://", "sha256", "commit", "checksum")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NUMBER = re.compile(r"[(0-9][0-9() .-]{8,}")
_LOCAL_PHONE = re.compile(r"(?<![0-9.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])")
_NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_SECRET = re.compile(r"(?i)(?:token|secret|password|passwd|api[_-]?key|access_key|private_key)\s*+[=:]\s*+(?:([\"'])([^\s\"']{8,}+)\1|([^\s\"'<>]{8,}+))")
#: Beginnings of published key formats, and their forms.
_KEY_STARTS = ("AKIA", "ghp_", "gho_", "ghs_", "eyJ", "xoxb-", "xoxp-", "sk_live_")
_KEY = re.compile(r"(?<![A-Za-z0-9_])(?:AKIA[0-9A-Z]{16}|gh[pos]_[A-Za-z0-9]{36,}+|eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]++|xox[bp]-[A-Za-z0-9-]{10,}+|sk_live_[A-Za-z0-9]{16,}+)(?![A-Za-z0-9_])")
_AT = re.compile(r"(?i) ?[(\[]at[)\]] ?")
_AFTER_AT = re.compile(r"(?i)[a-z0-9-]++ ?(?:[(\[]dot[)\]]|\.) ?[a-z]{2,}+(?!\w)")
_LAST_WORD = re.compile(r"(\w+)\W*\Z")
#: Classes of the word before a candidate.
WORD_CLASSES = 16
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_NAMES = frozenset(GIVEN_NAMES)
_SURNAME = re.compile(r" [A-ZÀ-Þ][a-zß-ÿ]++(?!\w)")


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    """Whether the digits carry a valid Luhn check digit."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += (2 * d - 9 if d > 4 else 2 * d) if i % 2 else d
    return total % 10 == 0


def find_emails(text: str) -> list:
    """Leftmost non-overlapping addresses, in time linear in the text.

    The part before an ``@`` is the longest run of local characters that ends
    there and starts at or after the end of the previous match.
    """
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)
    return out


def _matches(pattern, text, ok):
    good, bad = [], []
    for m in pattern.finditer(text):
        (good if ok(m.group()) else bad).append(m.span())
    return good, bad


def _ip_ok(s):
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:3] or 0) <= 255 for p in s.split("."))


def _card_ok(s):
    d = _digits(s)
    return 13 <= len(d) <= 19 and luhn(d)


def _phone_ok(s):
    return 9 <= len(_digits(s)) <= 15


def base_spans(text: str) -> dict:
    """Strict matches per kind, and the strict matches that failed their check."""
    ip, ip_bad = _matches(_IP, text, _ip_ok)
    card, card_bad = _matches(_CARD, text, _card_ok)
    phone, phone_bad = _matches(_PHONE, text, _phone_ok) if "+" in text else ([], [])
    return {"email": find_emails(text) if "@" in text else [], "ip": ip, "card": card, "phone": phone}, {"ip": ip_bad, "card": card_bad, "phone": phone_bad}


def _wide(text: str, low: str, bad: dict, names):
    """Candidates beyond the base: (kind, start, end)."""
    for s, e in bad["card"]:
        if 13 <= len(_digits(text[s:e])) <= 19:
            yield "card", s, e
    for s, e in bad["ip"]:
        yield "ip", s, e
    for s, e in bad["phone"]:
        yield "phone", s, e
    if any(w in low for w in SECRET_WORDS):
        for m in _SECRET.finditer(text):
            s, e = m.span(2) if m.group(1) else m.span(3)
            while not m.group(1) and e > s and text[e - 1] in ".,;:!?)]}":
                e -= 1
            if e - s >= 8:
                yield "secret", s, e
    if any(k in text for k in _KEY_STARTS):
        for m in _KEY.finditer(text):
            yield "secret", *m.span()
    if "(at)" in low or "[at]" in low:
        done = 0
        for m in _AT.finditer(text):
            start = m.start()
            while start > done and text[start - 1] in _LOCAL_CHARS:
                start -= 1
            if start < m.start() and (rest := _AFTER_AT.match(text, m.end())):
                yield "email", start, rest.end()
            done = m.end()
    for run in _NUMBER.finditer(text):
        before, after = text[run.start() - 1 : run.start()], text[run.end() : run.end() + 1]
        for kind, pattern in (("national_id", _NATIONAL), ("phone", _LOCAL_PHONE)):
            for m in pattern.finditer(run.group()):
                if not (m.start() == 0 and (before == "+" or before.isalnum()) or m.end() == len(run.group()) and after.isalnum()):
                    yield kind, run.start() + m.start(), run.start() + m.end()
    for end, size in names.iter(text):
        start = end + 1 - size
        if not text[start - 1 : start].isalnum() and (m := _SURNAME.match(text, end + 1)):
            yield "person", start, m.end()


def _name_finder():
    found = ahocorasick.Automaton()
    for name in GIVEN_NAMES:
        found.add_word(name, len(name))
    found.make_automaton()
    return found


def _share(s: str) -> float:
    return len(set(s)) / max(1, min(len(s), 16))


def votes(kind: str, text: str, low: str, s: int, e: int, strict: bool) -> str:
    """Six votes, each ``+`` (personal), ``-`` (not) or ``0`` (abstains)."""
    v, d = text[s:e], _digits(text[s:e])
    quoted = text[s - 1 : s] in ("'", '"') and text[s - 1 : s] == text[e : e + 1]
    regex = "+" if strict or kind == "national_id" or kind == "secret" and (quoted or v.startswith(_KEY_STARTS)) else "0"
    if kind == "card":
        valid = "+" if luhn(d) else "-"
        gazetteer = "+" if d[0] in "3456" and luhn(d) else "-" if d[0] not in "23456" else "0"
    elif kind == "ip":
        valid = "+" if _ip_ok(v) else "-"
        gazetteer = "-" if v.split(".")[0] in ("0", "127", "255") else "0"
    elif kind == "phone":
        valid = "+" if _phone_ok(v) else "-" if len(d) != 10 else "0"
        gazetteer = "+" if v[0] == "+" and d.startswith(COUNTRY_CODES) else "0"
    elif kind == "email":
        valid = "+" if v.count("@") == 1 and not v.startswith(".") else "0"
        gazetteer = "+" if re.split(r"[. )\]]", v.lower())[-1] in TOP_LEVEL else "0"
    elif kind == "secret":
        valid = "+" if len(v) >= 16 and d and len(d) < len(v) else "0" if len(v) >= 12 and (d or quoted) else "-"
        gazetteer = "-" if v.lower() in ("password", "changeme", "example", "undefined") else "0"
    elif kind == "national_id":
        valid = "-" if v.startswith(("000", "666", "9")) or v[4:6] == "00" or v.endswith("0000") else "+"
        gazetteer = "0"
    else:
        valid = "0"
        gazetteer = "+" if v.split(" ")[0] in _NAMES else "0"
    near = low[max(0, s - 40) : s]
    context = "+" if any(w in near for w in POSITIVE_CONTEXT[kind]) else "0"
    against = "-" if any(w in near for w in NEGATIVE_CONTEXT) else "0"
    shape = "-" if d and len(d) >= 7 and len(set(d)) <= 2 else "+" if kind == "secret" and d and _share(v) >= 0.5 else "0"
    return regex + valid + gazetteer + context + against + shape


def _edge(c: str) -> str:
    return "_" if not c or c.isspace() else "w" if c.isalnum() else "p"


def fold(text: str) -> str:
    """Lower case with the same positions: a character that grows when lowered stays as it is."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def pattern_key(kind, text, low, s, e, strict) -> str:
    """The candidate's features in one string with a bounded number of values.

    Kind, votes, edges and length; share of digits (4 classes), mixed case, variety of
    characters; the word before, hashed to 16 classes.
    """
    size = "s" if e - s < 12 else "m" if e - s < 24 else "l"
    v = text[s:e]
    digits = 4 * len(_digits(v)) // (len(v) + 1)
    mixed = "x" if v.upper() != v != v.lower() else "-"
    before = _LAST_WORD.search(low, max(0, s - 24), s)
    word = zlib.crc32(before.group(1).encode("utf-8", "surrogatepass")) % WORD_CLASSES if before else WORD_CLASSES
    return f"{kind}|{votes(kind, text, low, s, e, strict)}|{_edge(text[s - 1 : s])}{_edge(text[e : e + 1])}{size}|{digits}{mixed}{'v' if _share(v) >= 0.5 else '-'}|{word}"


class _Taken:
    """Whether a span meets any of the spans given, in logarithmic time."""

    def __init__(self, spans: list):
        spans = sorted(spans)
        self.starts, self.ends, end = [s for s, _ in spans], [], 0
        for _, e in spans:
            end = max(end, e)
            self.ends.append(end)

    def __call__(self, s: int, e: int) -> bool:
        k = bisect.bisect_left(self.starts, e)
        return k > 0 and self.ends[k - 1] > s


def _extract():
    names = _name_finder()

    def one(text):
        base, bad = base_spans(text)
        low = fold(text)
        found = [(k, s, e, pattern_key(k, text, low, s, e, True)) for k in BASE_KINDS for s, e in base[k]]
        taken = _Taken([(s, e) for _, s, e, _ in found])
        wide = [(k, s, e, pattern_key(k, text, low, s, e, False)) for k, s, e in _wide(text, low, bad, names) if not taken(s, e)]
        return [len(base[k]) for k in BASE_KINDS], found, wide

    def batch(texts):
        cols = [[] for _ in range(7)]
        for t in texts:
            n, found, wide = one(t)
            listed = ",".join(f"{k}:{s}:{e}" for k, s, e, _ in found)
            row = (*n, listed, [p for *_, p in found], [{"kind": k, "start": s, "stop": e, "pattern": p} for k, s, e, p in wide])
            for c, x in zip(cols, row):
                c.append(x)
        return cols

    return batch


_EXTRACTED = "n_email long, n_ip long, n_card long, n_phone long, base string, base_patterns array<string>, wide array<struct<kind:string,start:long,stop:long,pattern:string>>"


def expectation_maximisation(x: np.ndarray, n: np.ndarray, rounds: int = 100) -> tuple:
    """P(personal) of each vote pattern and P(outcome | class) as (class, labeler, outcome).

    ``x``: outcomes (0 for, 1 against, 2 abstains) by pattern and labeler; ``n``: counts.
    Reliabilities carry Dirichlet counts (2 % of all candidates, 1 at least) that
    say labelers are more often right than wrong, so rare kinds stay identified.
    The classes stay balanced, so the many strict matches don't vouch for doubtful ones.
    """
    hot = np.eye(3)[x]  # pattern, labeler, outcome
    prior = np.array([[4.0, 1.0, 3.0], [1.0, 4.0, 3.0]]) * (1 + 0.02 * n.sum())  # class personal, class other
    p = 1 / (1 + np.exp(-1.5 * ((x == 0).sum(1) - (x == 1).sum(1) - 0.5)))
    for _ in range(rounds):
        counts = np.stack([np.einsum("i,ilo->lo", n * p, hot), np.einsum("i,ilo->lo", n * (1 - p), hot)]) + prior[:, None, :]
        theta = counts / counts.sum(2, keepdims=True)
        score = np.einsum("ilo,clo->ci", hot, np.log(theta))
        new = 1 / (1 + np.exp(np.clip(score[1] - score[0], -50, 50)))
        settled = np.abs(new - p).max() < 1e-9
        p = new
        if settled:
            break
    return p, theta


def fit_label_model(patterns: list, rounds: int = 100) -> dict:
    """P(personal | votes) of each pattern key, from (pattern key, count); a model for each kind."""
    out: dict = {}
    outcome = {"+": 0, "-": 1, "0": 2}
    for kind in sorted({k.split("|")[0] for k, _ in patterns}):
        votes_of: dict = {}
        for k, c in sorted(patterns):
            if k.split("|")[0] == kind:
                votes_of.setdefault(k.split("|")[1], []).append((k, c))
        names = sorted(votes_of)
        x = np.array([[outcome[v] for v in name] for name in names])
        p, _ = expectation_maximisation(x, np.array([float(sum(c for _, c in votes_of[name])) for name in names]), rounds)
        out.update({k: float(q) for name, q in zip(names, p) for k, _ in votes_of[name]})
    return out


def _features(key: str) -> np.ndarray:
    kind, vote, shape, inside, word = key.split("|")
    x = [1.0] + [float(kind == k) for k in KINDS]
    x += [1.0 if v == "+" else -1.0 if v == "-" else 0.0 for v in vote]
    x += [float(shape[0] == c) for c in "_wp"] + [float(shape[1] == c) for c in "_wp"] + [float(shape[2] == c) for c in "sml"]
    x += [float(vote.count("+") >= 2), float("-" in vote)]
    x += [float(inside[0] == c) for c in "0123"] + [float(inside[1] == "x"), float(inside[2] == "v")]
    x += [float(int(word) == k) for k in range(WORD_CLASSES + 1)]
    return np.array(x)


def fit_span_classifier(patterns: list, soft: dict, rounds: int = 30, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression on the soft labels, weighted by damped counts (Newton steps)."""
    own = sorted(patterns)
    if not own:
        return np.zeros(len(_features("email|000000|__s|0--|0")))
    x = np.stack([_features(k) for k, _ in own])
    y = np.array([soft[k] for k, _ in own])
    n = np.log1p(np.array([float(c) for _, c in own]))
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (n * (p - y)) + ridge * w
        hess = (x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def accept(key: str, w: np.ndarray, threshold: float) -> bool:
    return float(1 / (1 + np.exp(-np.clip(_features(key) @ w, -30, 30)))) >= threshold


def extract_spans(docs: DataFrame, text_col: str = "text"):
    """``docs`` with a struct column ``_pii`` of base spans and candidates."""
    ship(docs.sparkSession)
    return docs.withColumn("_pii", per_text(_extract, _EXTRACTED)(F.col(text_col)))


def fit(extracted: DataFrame, threshold: float = 0.5) -> dict:
    """Fit both models on all candidates of all documents; the driver gets pattern counts."""
    counts = extracted.select(F.explode(F.concat("_pii.base_patterns", F.col("_pii.wide.pattern"))).alias("pattern")).groupBy("pattern").count()
    patterns = [(r[0], r[1]) for r in counts.collect()]  # bounded: see the module's text
    soft = fit_label_model(patterns)
    w = fit_span_classifier(patterns, soft)
    return {"weights": w, "soft": soft, "accepted": frozenset(k for k, _ in patterns if accept(k, w, threshold)), "threshold": threshold}


def _final(accepted):
    order = {k: i for i, k in enumerate(KINDS)}

    def make():
        def batch(base, wide):
            out = []
            for b, cands in zip(base, wide):
                spans = [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in b.split(",") if x)]
                end = 0
                for c in sorted(cands or [], key=lambda c: (c["start"], -c["stop"], order[c["kind"]])):
                    if c["pattern"] in accepted and c["start"] >= end:
                        spans.append((c["kind"], c["start"], c["stop"]))
                        end = c["stop"]
                spans.sort(key=lambda x: (order[x[0]], x[1], x[2]))
                out.append(",".join(f"{k}:{s}:{e}" for k, s, e in spans))
            return [out, [hashlib.sha256(b.encode()).hexdigest() for b in base]]

        return batch

    return make


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Spans of personal data per document: id, counts, base spans and all spans.

    See the module's text for method, bounds and edge cases.
    """
    found = materialise(extract_spans(docs.select(F.col(id_col), F.col(text_col)), text_col).select(id_col, "_pii"), "pii")
    model = fit(found, threshold)
    done = found.withColumn("_f", per_text(_final(model["accepted"]), "spans string, base_sha256 string", 2)(F.col("_pii.base"), F.col("_pii.wide")))
    return done.select(id_col, *(f"_pii.n_{k}" for k in BASE_KINDS), "_f.base_sha256", F.col("_pii.base").alias("base_spans"), "_f.spans")


def redact_text(text: str, spans: str) -> str:
    """Replace each span by its kind in angle brackets; overlapping spans share the first kind."""
    marks = sorted((int(s), int(e), k) for k, s, e in (x.split(":") for x in spans.split(",") if x))
    out, done = [], 0
    for s, e, k in marks:
        if s >= done:
            out += [text[done:s], f"<{k.upper()}>"]
        done = max(done, e)
    return "".join([*out, text[done:]])


def redact_pii(docs: DataFrame, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` with every span of personal data in ``text_col`` replaced; all other columns as they are.

    A null text stays null. The spans are found twice (once to fit, once to
    apply) rather than joined back by an id, so ids may be null or repeated.
    """
    spark = docs.sparkSession
    ship(spark)
    model = fit(extract_spans(docs.select(text_col), text_col), threshold)
    accepted = model["accepted"]

    def make():
        extract, final = _extract(), _final(accepted)()

        def batch(texts):
            *_, base, _, wide = extract(texts)
            return [[redact_text(t, s) for t, s in zip(texts, final(base, wide)[0])]]

        return batch

    done = per_text(make, "text string")(F.col(text_col))
    return docs.withColumn(text_col, F.when(F.col(text_col).isNotNull(), done["text"]))
