"""Secret scan: a linear-chain conditional random field beside exact patterns.

Text is cut into tokens; each is tagged secret begin (B), inside (I) or outside (O). Features are
the token's shape, length, alphabet and entropy, the words to either side, and what the whole file
looks like. Weights maximise the conditional likelihood (forward-backward, Adam) on a bounded,
hash-chosen sample in which the exact patterns give the labels, plus a few generated sequences
for formats that a sample may lack. Decoding is Viterbi.

Most tokens of prose can't belong to a secret. A token is free only within a few tokens of a
*core* (a run of token characters of MIN_CORE or more with a digit, or one without that is no plain
word: of mixed case, with signs, long, or of high entropy) or of a trigger word, and is clamped to O elsewhere.
A clamped token splits the chain, so each free stretch is decoded alone and exactly: the cost
follows the number of cores, not the length of the text.

Edge cases: null text counts as empty; an empty text has no spans; repeated rows are scanned
alike; an empty table gives an empty result (no model is needed then); extra columns are ignored.
"""
from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.llm.common import documents, hash_sample

KINDS = ("assign", "access", "hex", "model")
ASSIGN = re.compile(r"""(?a)((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]+(?:\.[A-Za-z0-9+/_=-]+)*|[^\sA-Za-z0-9]")
MIN_CORE = 8
RUN = re.compile(rf"[A-Za-z0-9+/_=.-]{{{MIN_CORE},}}")
DIGIT, UNLIKE_WORD = re.compile(r"[0-9]"), re.compile(r"[a-z][A-Z]|[+/_=]")
#: Runs without a digit count as cores from this length, or from ENTROPY bits a character and MIN_LETTERS.
LONG, MIN_LETTERS, ENTROPY = 20, 12, 3.0
#: Generated training texts; texts of the corpus longer than this don't train (their sequences would meet on the driver).
GENERATED, TRAIN_CHARS = 1500, 20_000
#: Tokens to either side of a core that stay free.
REACH = 5
TRIGGERS = frozenset("password passwd pwd pass passphrase secret client_secret token key apikey api_key auth authorization bearer basic credential credentials access private signature login dsn".split())
TRIGGER = re.compile(rf"(?ai)(?<![A-Za-z0-9])(?:{'|'.join(sorted(TRIGGERS))})(?![A-Za-z0-9])")
O, B, I = 0, 1, 2
TOKEN_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=.-")
TAIL = re.compile(r"[A-Za-z0-9+/_=.-]*")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the exact patterns, leftmost and non-overlapping within a kind."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(out)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def is_core(run: str) -> bool:
    if DIGIT.search(run):
        return True
    run = run.strip(".-=")
    n = len(run)
    return n >= MIN_CORE and (n >= LONG or UNLIKE_WORD.search(run) is not None or (n >= MIN_LETTERS and entropy(run) >= ENTROPY))


def free_stretches(text: str) -> list[list[tuple[int, int]]]:
    """Stretches of tokens near a core or trigger, as (start, end) lists; tokens outside them are clamped to O."""
    cores = [m.span() for m in RUN.finditer(text) if is_core(m.group())]
    low = text.lower()
    if any(t in low for t in TRIGGERS):
        cores = sorted(cores + [m.span() for m in TRIGGER.finditer(text)])
    zones: list[list[int]] = []
    for a, b in cores:
        lo, hi = max(0, a - 60), min(len(text), b + 40)
        if zones and lo <= zones[-1][1]:
            zones[-1][1], zones[-1][3] = max(hi, zones[-1][1]), max(b, zones[-1][3])
        else:
            zones.append([lo, hi, a, b])
    out = []
    for lo, hi, first, end in zones:
        # A zone's ends move out to the ends of the tokens that they lie in, however long those are.
        while lo > 0 and text[lo - 1] in TOKEN_CHARS:
            lo -= 1
        hi = TAIL.match(text, max(hi, end)).end()
        toks = [m.span() for m in TOKEN.finditer(text, lo, hi)]
        i = next((k for k, t in enumerate(toks) if t[1] > first), len(toks))
        j = next((k for k in range(len(toks) - 1, -1, -1) if toks[k][0] < end), -1)
        out.append(toks[max(0, i - REACH) : j + 1 + REACH])
    return [x for x in out if x]


def file_features(text: str) -> list[str]:
    n = max(1, len(text))
    marks = text.count("=") + text.count(";") + text.count("{")
    return ["f:code" if marks * 200 > n else "f:prose", "f:short" if n < 300 else "f:long"]


def shape(tok: str) -> str:
    s = re.sub(r"[a-z]+", "a", re.sub(r"[A-Z]+", "A", re.sub(r"[0-9]+", "0", tok)))
    return s if len(s) <= 6 else s[:3] + "~" + str(min(9, len(s) // 4))


def alphabet(tok: str) -> str:
    if re.fullmatch(r"[0-9.-]+", tok):
        return "num"
    if re.fullmatch(r"[0-9a-fA-F]+", tok):
        return "hex"
    if re.fullmatch(r"[a-z]+|[A-Z][a-z]*|[A-Z]+", tok):
        return "word"
    if re.fullmatch(r"[A-Z0-9]+", tok):
        return "upnum"
    return "mixed" if re.fullmatch(r"[A-Za-z0-9+/_.=-]+", tok) else "sym"


def entropy(tok: str) -> float:
    n = len(tok)
    return -sum(c / n * math.log2(c / n) for c in Counter(tok).values())


def features(text: str, toks: list[tuple[int, int]], of_file: list[str]) -> list[list[str]]:
    own = []
    for s, e in toks:
        t = text[s:e]
        a, n = alphabet(t), e - s
        own.append((f"a:{a}", f"l:{a}{min(6, n // 6)}", f"h:{int(entropy(t) * 2) if n >= 6 else 'x'}:{a}", f"s:{shape(t)}", "t:" + ("yes" if t.lower().strip("_") in TRIGGERS else "=" if t in "=:" else "q" if t in "\"'" else "no")))
    out = []
    for i, f in enumerate(own):
        row = [*f, *of_file, "bias"]
        for d in (-3, -2, -1, 1):
            row.append(f"{d}{own[i + d][4]}" if 0 <= i + d < len(own) else f"{d}edge")
        row.append("-1" + (own[i - 1][0] if i else "edge"))
        row.append("+1" + (own[i + 1][0] if i + 1 < len(own) else "edge"))
        glued = i and toks[i - 1][1] == toks[i][0]
        row.append(f"g:{bool(glued)}:{f[0]}")
        out.append(row)
    return out


@dataclass
class Crf:
    """Emission weights by feature, and transition scores; state order O, B, I."""

    weight: dict[str, tuple[float, float, float]] = field(default_factory=dict)
    step: list[list[float]] = field(default_factory=lambda: [[0.0] * 3 for _ in range(3)])

    def decode(self, rows: list[list[str]]) -> list[int]:
        zero = (0.0, 0.0, 0.0)
        back, v = [], None
        for row in rows:
            ws = [self.weight.get(f, zero) for f in row]
            em = [sum(w[k] for w in ws) for k in range(3)]
            if v is None:
                v = [em[0], em[1], -1e9]  # a stretch follows a clamped O
                continue
            best = [max(range(3), key=lambda p, k=k: v[p] + self.step[p][k]) for k in range(3)]
            v = [v[best[k]] + self.step[best[k]][k] + em[k] for k in range(3)]
            back.append(best)
        k = max(range(3), key=lambda s: v[s])
        path = [k]
        for best in reversed(back):
            k = best[k]
            path.append(k)
        return path[::-1]

    def spans(self, text: str) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        stretches = free_stretches(text)
        of_file = file_features(text) if stretches else []
        for toks in stretches:
            open_at = None
            for (s, e), k in zip(toks, self.decode(features(text, toks, of_file)), strict=True):
                if k == B:
                    out.append((s, e))
                    open_at = len(out) - 1
                elif k == I and open_at is not None:
                    out[open_at] = (out[open_at][0], e)
                else:
                    open_at = None
        return out


def tagged(text: str, known: tuple[tuple[int, int, int], ...] = ()) -> list[tuple[list[list[str]], list[int]]]:
    """Training sequences of a text: the known spans give the tags, and where none are known the exact patterns."""
    spans, of_file, out = list(known) or base_spans(text), file_features(text), []
    for toks in free_stretches(text):
        tags = []
        for s, e in toks:
            hit = next((x for x in spans if x[0] < e and s < x[1]), None)
            tags.append(O if hit is None else B if not tags or tags[-1] == O or s <= hit[0] else I)
        out.append((features(text, toks, of_file), tags))
    return out


def generated(n: int, seed: int) -> list[tuple[str, tuple[tuple[int, int, int], ...]]]:
    """Texts with secrets of common formats, with their spans, and with long tokens that are no secrets.

    The exact patterns know assignments to five names, one vendor's keys and hex; these formats are what they miss:
    other names and separators, prefixed keys, bearer and basic headers, passwords in addresses, web tokens, phrases.
    """
    rng = random.Random(seed)
    pick = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    alnum = low + up + dig
    word = lambda: pick(low, rng.randint(2, 9))
    name = lambda: rng.choice(("pwd", "auth", "password", "passphrase", "key", "credential", "secret", "client_secret", "access_token", "private_key", "login", "pass", "db_password", "signing_key"))
    sep = lambda: rng.choice((": ", " = ", "=", " ", " is ", " := ", " => ", '": "', "='", ' = "'))
    value = lambda: rng.choice((
        lambda: pick(alnum, rng.randint(8, 40)), lambda: pick(low + dig, rng.randint(10, 32)), lambda: pick(low + up, rng.randint(10, 24)), lambda: pick(alnum + "+/", rng.randint(20, 60)) + rng.choice(("", "=", "==")),
        lambda: pick(alnum, rng.randint(6, 8)), lambda: pick(alnum + "_-", rng.randint(16, 40)), lambda: "-".join(word() for _ in range(rng.randint(3, 5))), lambda: "".join(word() for _ in range(rng.randint(3, 4))),
        lambda: "-".join(pick(low + dig, k) for k in (8, 4, 4, 4, 12)),
    ))()
    tag = lambda: pick(low, rng.randint(2, 4)) + rng.choice("_-") + rng.choice(("", pick(low, 4) + "_"))
    jwt = lambda: ".".join(["eyJ" + pick(alnum, rng.randint(12, 30)), "eyJ" + pick(alnum, rng.randint(20, 60)), pick(alnum + "_-", rng.randint(20, 43))])
    out = []
    for _ in range(n):
        # (before the secret, the secret, after it)
        lead, good, tail = rng.choice([
            lambda: ("password: ", pick(alnum, rng.randint(10, 24)), ""),
            lambda: ("", "AKIA" + pick(up + dig, 16), ""),
            lambda: ("", pick("0123456789abcdef", rng.choice([32, 40, 64])), ""),
            lambda: (name() + sep(), value(), rng.choice(("", '"', "'", ";"))),
            lambda: (name() + sep(), value(), ""),
            lambda: (name().upper() + rng.choice(("=", ": ")), value(), ""),
            lambda: (name() + sep(), tag() + pick(alnum, rng.randint(12, 40)), ""),
            lambda: ("", tag() + pick(alnum, rng.randint(20, 40)), ""),
            lambda: (f"{rng.choice(('Authorization: Bearer', 'Bearer', 'bearer', 'auth', 'Authorization: Basic', 'Basic'))} ", rng.choice((value, jwt))(), ""),
            lambda: ("", jwt(), ""),
            lambda: (f"{word()}://{word()}:", pick(alnum, rng.randint(8, 20)), f"@{word()}.{word()}.com/{word()}"),
            lambda: ("", pick(low + up, rng.randint(18, 40)), ""),
        ])()
        plain = rng.choice([
            lambda: f"{word()}.{rng.randint(1, 99)}@mail{rng.randint(1, 9)}.example.com",
            lambda: f"+1 ({pick(dig, 3)}) 555-{pick(dig, 4)}",
            lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)),
            lambda: pick(dig, 16),
            lambda: " ".join(pick(dig, 4) for _ in range(4)),
            lambda: f"https://{word()}.com/{word()}/{rng.randint(1, 9999)}/{word()}-{word()}",
            lambda: f"https://www.{word()}.org/{word()}_{word()}?{word()}={rng.randint(1, 99)}",
            lambda: f"20{pick(dig, 2)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}T10:00:00",
            lambda: f"{word()}-{word()}-{rng.randint(1, 2030)}",
            lambda: f"the {rng.choice(sorted(TRIGGERS))} {word()} {word()}",
            lambda: f"{rng.choice(sorted(TRIGGERS))} is {word()} {word()}",
            lambda: f"{rng.choice(sorted(TRIGGERS))}: {word()} {word()}, {word()}",
            lambda: pick(low, rng.randint(10, 16)),
            lambda: f"{rng.choice(('password', 'PASSWD', 'pwd', 'token'))}{rng.choice((': ', ' = ', '='))}{rng.choice(('', chr(39)))}{pick(low, rng.randint(1, 4))}{chr(39)}",
            lambda: f"{word().title()}{word().title()}",
            lambda: f"{word()}_{word()}({word()}, {word()}_{rng.randint(0, 99)})",
            lambda: f"{word()}/{word()}/{word()}.{rng.choice(('py', 'java', 'html'))}",
        ])()
        pad = lambda: " ".join(word() for _ in range(rng.randint(3, 8)))
        before = pad() + " " + lead
        at = (len(before), len(before) + len(good), 3)
        out.append((f"{before}{good}{tail} {pad()} {plain} {pad()}", (at,)) if rng.random() < 0.65 else (f"{pad()} {plain} {pad()} {plain}", ()))
    return out


def train(texts: list[str], rounds: int = 80, l2: float = 1e-3, seed: int = 7) -> Crf:
    """Maximum conditional likelihood over the texts and the generated ones, in 3-state padded batches."""
    data = [x for t, known in [*((t, ()) for t in texts), *generated(GENERATED, seed)] for x in tagged(t, known)]
    index: dict[str, int] = {}
    for rows, _ in data:
        for row in rows:
            for f in row:
                index.setdefault(f, len(index) + 1)
    cut = 40
    data = [(r[i : i + cut], y[i : i + cut]) for r, y in data for i in range(0, len(r), cut)]
    n, t, k = len(data), max(len(y) for _, y in data), max(len(row) for r, _ in data for row in r)
    idx, tag, on = np.zeros((n, t, k), np.int64), np.zeros((n, t), np.int64), np.zeros((n, t), bool)
    for a, (rows, y) in enumerate(data):
        for b, row in enumerate(rows):
            idx[a, b, : len(row)] = [index[f] for f in row]
        tag[a, : len(y)], on[a, : len(y)] = y, True
    w, step = np.zeros((len(index) + 1, 3)), np.zeros((3, 3))
    gold = np.eye(3)[tag] * on[..., None]
    gold_step = np.einsum("ntp,ntq->pq", gold[:, :-1], gold[:, 1:])
    m1, m2 = [np.zeros_like(w), np.zeros_like(step)], [np.zeros_like(w), np.zeros_like(step)]
    lse = lambda x, ax: (m := x.max(ax, keepdims=True)).squeeze(ax) + np.log(np.exp(x - m).sum(ax))
    flat = idx.reshape(-1, k)
    for it in range(1, rounds + 1):
        em = w[idx].sum(2)
        al, be = np.zeros((n, t, 3)), np.zeros((n, t, 3))
        al[:, 0] = em[:, 0]
        for b in range(1, t):
            al[:, b] = np.where(on[:, b, None], lse(al[:, b - 1, :, None] + step, 1) + em[:, b], al[:, b - 1])
        for b in range(t - 2, -1, -1):
            be[:, b] = np.where(on[:, b + 1, None], lse(step + (em[:, b + 1] + be[:, b + 1])[:, None, :], 2), be[:, b + 1])
        z = lse(al[:, -1], 1)
        p = np.exp(al + be - z[:, None, None]) * on[..., None]
        pair = np.zeros((3, 3))
        for b in range(1, t):
            x = al[:, b - 1, :, None] + step + (em[:, b] + be[:, b])[:, None, :] - z[:, None, None]
            pair += (np.exp(x) * on[:, b, None, None]).sum(0)
        diff = (gold - p).reshape(-1, 3)
        gw = np.zeros_like(w)
        for c in range(k):
            for s in range(3):
                gw[:, s] += np.bincount(flat[:, c], diff[:, s], minlength=len(w))
        gw[0] = 0
        for g, par, q in ((gw / n - l2 * w, w, 0), ((gold_step - pair) / n - l2 * step, step, 1)):
            m1[q] = 0.9 * m1[q] + 0.1 * g
            m2[q] = 0.999 * m2[q] + 0.001 * g * g
            par += 0.25 * (m1[q] / (1 - 0.9**it)) / (np.sqrt(m2[q] / (1 - 0.999**it)) + 1e-8)
    step[O, I] = -1e9  # I follows B or I only
    names = {f: tuple(round(float(x), 5) for x in w[i]) for f, i in index.items() if np.abs(w[i]).max() > 1e-4}
    return Crf(names, [[float(x) for x in row] for row in step])


def fit(docs: DataFrame, sample_rows: int = 1500, most_chars: int = TRAIN_CHARS) -> Crf:
    """Train on at most 1.25 * sample_rows texts of under most_chars: most hold a sign of assignment, the others are any rows."""
    short = docs.where(F.length("text") < most_chars)
    # Ids are chosen first, so that no texts meet in one task; there are 1.25 * sample_rows at most.
    signs = hash_sample(short.where(F.contains("text", F.lit("="))).select("doc_id"), "doc_id", sample_rows)
    rest = hash_sample(short.select("doc_id"), "doc_id", sample_rows // 4, 18)
    ids = signs.union(rest).distinct()
    return train([r.text for r in docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi").dropDuplicates(["doc_id"]).orderBy("doc_id").collect()])


def scan(text: str, model: Crf) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans): the method adds spans that overlap no base one."""
    base = base_spans(text)
    extra = [(s, e, 3) for s, e in model.spans(text) if not any(a < e and s < b for a, b, _ in base)]
    return base, sorted(base + extra)


def find_secrets(docs: DataFrame, model: Crf | None = None) -> DataFrame:
    """doc_id, base and all spans as arrays of (kind, start, end) in code points."""
    import pyarrow as pa

    model = model or fit(docs)
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    schema = "doc_id bigint, base array<struct<kind string, start bigint, end bigint>>, spans array<struct<kind string, start bigint, end bigint>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        as_rows = lambda xs: [{"kind": KINDS[k], "start": s, "end": e} for s, e, k in xs]
        for batch in batches:
            found = [scan(t or "", model) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([as_rows(b) for b, _ in found], pa.list_(span)), pa.array([as_rows(a) for _, a in found], pa.list_(span))], ["doc_id", "base", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def digest(found: DataFrame) -> DataFrame:
    """The columns of the query from the operator's spans."""
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    n = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"))


def op1_secrets(spark, sf_dir: str) -> DataFrame:
    return digest(find_secrets(documents(spark, sf_dir)))


def sha(spans: list[tuple[int, int, int]]) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()
