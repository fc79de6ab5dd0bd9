"""Personal data and secrets: patterns, and a character tagger for what they miss.

Patterns find emails, ip addresses, cards and phones, each kind on its own. The tagger, a
bidirectional LSTM with CRF transitions, is trained from labelled spans; the samples are invented
from rules with a fixed seed, `SAMPLES` of them, and need no data. It reads overlapping windows
around all characters that spans which pass its checks cannot be without (ANCHOR: a digit, an at sign, an equals
sign, or a run of capitals), or, with `whole`, over the whole text: that costs about a hundred times as much and can only add spans
whose characters the windows around anchors show with too little text beside them.
The windows' scores meet weighted by how far from its window's ends a character is, and one
decoding over the whole stretch reconciles them. Stretches longer than PIECE are decoded in
pieces, and spans that touch at a seam are joined. The tagger's spans of the patterns' kinds must pass the
patterns' checks; it adds those that overlap none of their kind, and secrets. Spans of the patterns always stay.

Each text is read whole, in one task, with memory in proportion to the text. Offsets count code
points, ends are exclusive. Null and empty texts have no spans. Rows are judged one by one, so ids may be
null or repeated; all columns stay, and those called `spans` or `redacted` are replaced. An empty table
gives an empty one.
"""

from __future__ import annotations

import hashlib
import inspect
import pickle
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm.common import carried, restored
from logloom.llm.tagger import WINDOW, Span, Tagger, symbols, train
from logloom.session import shared_folder

KINDS = ("email", "ip", "card", "phone", "secret")
SAMPLES = 6000
ANCHOR = re.compile("[0-9@=]+|[A-Z]{12,}")
NEAR = 32  # characters around an anchor that are read with it
PIECE = 1024
STRIDE = WINDOW // 2
BATCH = 2048  # windows at a time
SPAN_TYPE = "array<struct<kind:string,start:int,end:int,base:boolean>>"

AT_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGITS = re.compile("[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def is_card(text: str) -> bool:
    digits = NOT_DIGITS.sub("", text)
    return 13 <= len(digits) <= 19 and luhn(digits)


def is_phone(text: str) -> bool:
    return 9 <= len(NOT_DIGITS.sub("", text)) <= 15


def is_ip(text: str) -> bool:
    parts = text.split(".")
    return len(parts) == 4 and all(p.isascii() and p.isdigit() and int(p.lstrip("0")[:4] or 0) <= 255 for p in parts)


def emails(text: str) -> Iterator[Span]:
    done = 0
    for m in AT_DOMAIN.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            yield "email", start, m.end()
            done = m.end()


def ips(text: str) -> Iterator[Span]:
    """Of a run of numbers with dots, each four; in one pass however long the run."""
    for m in DOTTED.finditer(text):
        parts = m.group().split(".")
        at = m.start()
        for i in range(0, len(parts) - 3, 4):
            four = ".".join(parts[i : i + 4])
            if is_ip(four):
                yield "ip", at, at + len(four)
            at += len(four) + 1


def base_spans(text: str) -> list[Span]:
    """What the patterns find, by kind, then start."""
    out = list(emails(text)) if "@" in text else []
    out += ips(text)
    out += [("card", m.start(), m.end()) for m in CARD.finditer(text) if m.end() - m.start() >= 13 and is_card(m.group())]
    out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if is_phone(m.group())]
    return out


def stretches(text: str, whole: bool = False) -> list[tuple[int, int]]:
    """What the tagger reads of a text: pieces around anchors, or all, in order."""
    if whole:
        return [(a, min(a + PIECE, len(text))) for a in range(0, len(text), PIECE)]
    joined: list[list[int]] = []
    for m in ANCHOR.finditer(text):
        a, b = max(0, m.start() - NEAR), min(len(text), m.end() + NEAR)
        if joined and a <= joined[-1][1]:
            joined[-1][1] = b
        else:
            joined.append([a, b])
    return [(a, min(a + PIECE, stop)) for start, stop in joined for a in range(start, stop, PIECE)]


def plausible(kind: str, found: str) -> bool:
    """Whether a span of the tagger passes the checks of its kind."""
    if kind == "email":
        return AT_DOMAIN.search(found) is not None and not re.search("[\x20\t-\r]", found) and not found.startswith("@")
    if kind == "ip":
        return is_ip(found)
    if kind == "card":
        return CARD.fullmatch(found) is not None and is_card(found)
    if kind == "phone":
        return re.fullmatch(r"[+(]?[0-9][\x20().0-9/-]*[0-9]", found) is not None and is_phone(found) and ("+" in found or re.search(r"[0-9][\x20)-]+[(0-9]", found) is not None)
    return re.fullmatch(r"[A-Za-z0-9_+/=.~-]{12,}", found) is not None and len(set(found)) >= 6 and (re.search("[0-9]", found) is not None or found.isupper())


def tagged(texts: list[str], tagger: Tagger, whole: bool = False) -> list[list[Span]]:
    """The tagger's spans of each text, before any check."""
    pieces = [(i, a, b) for i, text in enumerate(texts) for a, b in stretches(text, whole)]
    ids = {i: symbols(texts[i]) for i in {i for i, _, _ in pieces}}
    weight = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(np.float32)
    out: list[list[Span]] = [[] for _ in texts]
    pieces.sort(key=lambda p: (p[2] - p[1], p))  # pieces of about one length are decoded together
    at = 0
    while at < len(pieces):
        stop, windows = at, 0
        while stop < len(pieces) and windows < BATCH:
            windows += -(-(pieces[stop][2] - pieces[stop][1]) // STRIDE) + 1
            stop += 1
        group, length = pieces[at:stop], pieces[stop - 1][2] - pieces[stop - 1][1]
        each = -(-length // STRIDE) + 1
        rows = np.zeros((len(group), each * STRIDE + STRIDE), np.int16)  # half a window before the piece and behind it
        for row, (i, a, b) in enumerate(group):
            first, last = max(0, a - STRIDE), min(len(ids[i]), a - STRIDE + rows.shape[1])
            rows[row, first - a + STRIDE : last - a + STRIDE] = ids[i][first:last]
        scores = np.zeros((*rows.shape, tagger.tags), np.float32)
        weights = np.zeros(rows.shape[1], np.float32)
        for start in range(0, rows.shape[1] - WINDOW + 1, STRIDE):
            scores[:, start : start + WINDOW] += tagger.scores(rows[:, start : start + WINDOW]) * weight[:, None]
            weights[start : start + WINDOW] += weight
        inner = slice(STRIDE, STRIDE + length)
        lengths = np.array([b - a for _, a, b in group])
        tags = tagger.decode(scores[:, inner] / weights[inner, None], lengths)
        for (i, a, b), row in zip(group, tags, strict=True):
            out[i] += tagger.spans(row[: b - a], a)
        at = stop
    ends = {(i, b) for i, _, b in pieces}
    seams = {(i, a) for i, a, _ in pieces} & ends
    for i, spans in enumerate(out):
        joined: list[Span] = []
        for kind, a, b in sorted(spans, key=lambda s: s[1:]):
            if joined and joined[-1][0] == kind and joined[-1][2] == a and (i, a) in seams:
                a = joined.pop()[1]
            joined.append((kind, a, b))
        out[i] = joined
    return out


def all_spans(texts: list[str], tagger: Tagger, whole: bool = False) -> list[list[tuple[str, int, int, bool]]]:
    """Spans with whether a pattern found them, by kind, then start."""
    out = []
    for text, more in zip(texts, tagged(texts, tagger, whole), strict=True):
        base = base_spans(text)
        spans = [(*s, True) for s in base]
        for kind, a, b in more:
            if plausible(kind, text[a:b]) and not any(k == kind and a < end and start < b for k, start, end in base):
                spans.append((kind, a, b, False))
        out.append(sorted(spans, key=lambda s: (KINDS.index(s[0]), *s[1:])))
    return out


def redacted(text: str, spans: list[tuple[str, int, int, bool]]) -> str:
    """`text` with each span, and each run of overlapping ones, as its first kind in brackets."""
    parts, at = [], 0
    for kind, a, b, _ in sorted(spans, key=lambda s: s[1:3]):
        if a >= at:
            parts += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join([*parts, text[at:]])


def invented_samples(n: int = SAMPLES, seed: int = 1) -> list[tuple[str, list[Span]]]:
    """Texts of made-up words with labelled spans, and with numbers that are nobody's."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    many = lambda chars, low, high: "".join(pick(chars) for _ in range(int(rng.integers(low, high + 1))))
    low, digits, hexes = "abcdefghijklmnopqrstuvwxyz", "0123456789", "0123456789abcdef"
    upper = low.upper()

    def word() -> str:
        syllables = ["an", "er", "on", "th", "in", "the", "es", "re", "ou", "ti", "ment", "aux", "é", "è", "ch", "ein", "ü", "ß", "sch", "os", "ción", "ñ", "ar", "ly", "ing"]
        out = "".join(pick(syllables) for _ in range(int(rng.integers(1, 5))))
        kind = rng.random()
        return out.capitalize() if kind < 0.12 else out.upper() + "!!" if kind < 0.15 else out

    def number(n: int) -> str:
        return "".join(pick(digits) for _ in range(n))

    def card() -> str:
        body = number(int(pick([12, 14, 15, 15, 15, 15, 18])))
        check = next(c for c in digits if luhn(body + c))
        whole = body + check
        sep = pick(["", "", " ", "-"])
        return sep.join(whole[i : i + 4] for i in range(0, len(whole), 4)) if sep else whole

    def phone() -> str:
        return pick([
            lambda: f"+{number(1)} ({number(3)}) {number(3)}-{number(4)}", lambda: f"+{number(2)} {number(3)} {number(7)}",
            lambda: f"+{number(2)}-{number(2)}-{number(4)}-{number(4)}", lambda: f"({number(3)}) {number(3)}-{number(4)}",
            lambda: f"{number(3)}-{number(3)}-{number(4)}", lambda: f"+{number(11)}",
        ])()

    def email() -> str:
        local = many(low, 2, 9) + pick(["", ".", "_", "-", "+"]).join(["", many(low + digits, 1, 6)])
        return f"{local}@{many(low, 3, 9)}{pick(['', number(1)])}.{pick(['example.com', 'com', 'org', 'net', 'de', 'co.uk', 'example.net'])}"

    def secret() -> tuple[str, str, str]:
        value = pick([
            lambda: many(hexes, 40, 40), lambda: many(hexes, 16, 20), lambda: many(hexes, 32, 32), lambda: many(low + upper + digits, 20, 40),
            lambda: pick(["sk_", "ghp_", "key-"]) + many(low + digits, 20, 32),
        ])()
        name = pick(["token", "password", "passwd", "secret", "api_key", "apikey", "key", "pwd", "access_token", "TOKEN", "API_KEY"])
        sign = pick(["=", " = ", ": ", ":", "="])
        quote = pick(["", '"', "'"]) if sign != " = " else pick(['"', '"', "'", ""])
        if rng.random() < 0.3:
            return "", pick(["AKIA", "AKIA", "ASIA"]) + many(upper + "234567", 16, 16), ""
        return name + sign + quote, value, quote

    def nobody() -> str:
        return pick([
            lambda: f"Version {number(1)}.{number(1)}.", lambda: f"version {number(1)}", lambda: f"BY-NC {number(1)}.0", lambda: pick(["19", "20"]) + number(2),
            lambda: f"20{number(2)}-{number(2)}-{number(2)}", lambda: f"{number(2)}.{number(2)}.20{number(2)}", lambda: number(int(rng.integers(1, 8))),
            lambda: f"{number(2)},{number(3)}", lambda: f"${number(2)}.{number(2)}", lambda: f"{word()} = {number(int(rng.integers(1, 4)))}", lambda: f"page={number(1)}",
            lambda: f"{word()}={word()}", lambda: f"v{number(1)}.{number(1)}.{number(2)}", lambda: f"{number(1)}.{number(4)}", lambda: f"@{word()}", lambda: f"{word()}@",
            lambda: f"{number(2)}:{number(2)}", lambda: f"{number(int(rng.integers(9, 13)))}", lambda: f"a{number(2)}", lambda: many(upper, 12, 18), lambda: f"{word()}{number(2)}",
            lambda: f"https://www.{many(low, 4, 8)}.com/en/{number(5)}?page={number(1)}", lambda: f"#{many(hexes, 6, 6)}", lambda: "x = y", lambda: f"{number(3)}%",
        ])()

    samples = []
    for _ in range(n):
        parts, spans, at = [], [], 0

        def add(text: str, parts=parts) -> int:
            parts.append(text)
            return len(text)

        for _ in range(int(rng.integers(12, 26))):
            draw = rng.random()
            if draw < 0.16:
                kind = pick(KINDS)
                before, value, behind = secret() if kind == "secret" else ("", {"email": email, "ip": lambda: ".".join(str(int(rng.integers(256))) for _ in range(4)), "card": card, "phone": phone}[kind](), "")
                at += add(before)
                spans.append((kind, at, at + len(value)))
                at += add(value + behind + pick(["", "", "", ".", ","]))
            else:
                at += add((nobody() if draw < 0.24 else word()) + pick(["", "", "", "", ".", ","]))
            at += add(pick([" ", " ", " ", " ", " ", " ", "\n"]))
        samples.append(("".join(parts), spans))
    return samples


@lru_cache(maxsize=2)
def trained(samples: int = SAMPLES, seed: int = 1) -> Tagger:
    """The tagger of the invented samples; the same for each run."""
    return train(invented_samples(samples, seed), KINDS)


def kept(spark: SparkSession, samples: int = SAMPLES, seed: int = 1) -> Tagger:
    """The tagger of the invented samples, from the shared folder if a session has left it there.

    It is kept under a digest of the settings and of the code that makes it.
    """
    code = "".join(inspect.getsource(x) for x in (invented_samples, inspect.getmodule(Tagger)))
    digest = hashlib.sha256(f"{KINDS} {samples} {seed} {np.__version__}\n{code}".encode()).hexdigest()
    path = f"{shared_folder(spark).rstrip('/')}/tagger-{digest}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        return pickle.loads(spark.read.parquet(path).first()["tagger"])
    tagger = trained(samples, seed)
    table = spark.createDataFrame([(pickle.dumps(tagger),)], "tagger binary")
    table.coalesce(1).write.mode("overwrite").parquet(path)
    return tagger


def find(docs: DataFrame, text_column: str = "text", tagger: Tagger | None = None, redact: bool = False, whole: bool = False) -> DataFrame:
    """`docs` with `spans` (SPAN_TYPE) and, if asked for, the `redacted` text. With `whole`, the tagger reads all of each text."""
    model = docs.sparkSession.sparkContext.broadcast(tagger or kept(docs.sparkSession))

    def judged(text: Column) -> Column:
        @F.arrow_udf(f"struct<spans:{SPAN_TYPE},redacted:string>")
        def judge(column: pa.Array) -> pa.Array:
            texts = [x or "" for x in column.to_pylist()]
            found = all_spans(texts, model.value, whole)
            names = ("kind", "start", "end", "base")
            kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])
            spans = pa.array([[dict(zip(names, s, strict=True)) for s in row] for row in found], pa.list_(kind))
            cleaned = [None if x is None else redacted(t, s) for x, t, s in zip(column.to_pylist(), texts, found, strict=True)] if redact else [None] * len(texts)
            return pa.StructArray.from_arrays([spans, pa.array(cleaned, pa.string())], ["spans", "redacted"])

        return judge(text)

    rows = carried(docs, found=judged(F.col(f"`{text_column}`")))
    new = {"spans": F.col("found")["spans"]} | ({"redacted": F.col("found")["redacted"]} if redact else {})
    return restored(rows, docs.columns, **new)


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")
