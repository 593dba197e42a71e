"""Secret scans: all rules in one minimal automaton, one pass over the bytes of each text.

The pass gives, for every byte, the rules of which a match ends there. The end of each span is the last of such bytes in a
row; its start is the furthest one that the reversed rule reads back to, the leftmost. That is leftmost and longest as
long as a rule's match goes on to the end of its last repeated class, as these rules' do. A rule's spans don't overlap.

Null and empty texts have no spans. Offsets count code points, ends are exclusive. Ties and repeated rows are scanned
row by row; further columns pass through `scan_secrets` and `redact_secrets` untouched, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes as tb
from .automaton import Dfa, alt, backwards, cat, chars, opt, rep, word

VALUE = chars("A-Za-z0-9+/_.=-")
QUOTE = chars("\"'")
ALNUM = chars("A-Za-z0-9")


def _assign(least: int):
    names = alt(word("password", True), word("passwd", True), word("secret", True), word("token", True), cat(word("api", True), opt(chars("_")), word("key", True)))
    return cat(names, opt(QUOTE), rep(chars(" ")), chars(":="), rep(chars(" ")), opt(QUOTE), rep(VALUE, least))


#: kind: the rule. Spans that `KEPT` rejects are used up all the same.
RULES = {
    "assign": _assign(1),
    "access": cat(word("AKIA"), rep(chars("A-Z0-9"), 16)),
    "hex": rep(chars("0-9a-f"), 24),
    "pem": cat(word("-----BEGIN "), rep(chars("A-Z ")), word("PRIVATE KEY-----")),
    "slack": cat(word("xox"), chars("abprs"), word("-"), rep(chars("A-Za-z0-9-"), 10)),
}
KEPT = {"assign": _assign(6)}
BASE = ("assign", "access", "hex")
_made: dict[str, object] = {}


def automata() -> tuple[Dfa, dict[str, Dfa], dict[str, Dfa]]:
    """The searching automaton of all rules; each rule's reversed one; what is kept, from its start on."""
    if not _made:
        _made["all"] = Dfa(list(RULES.values()), search=True)
        _made["back"] = {kind: Dfa([backwards(rule)], search=False) for kind, rule in RULES.items()}
        _made["kept"] = {kind: Dfa([rule], search=False) for kind, rule in KEPT.items()}
    return _made["all"], _made["back"], _made["kept"]


def find(buf: np.ndarray, offsets: np.ndarray, made=None) -> list[tuple[int, int, int, int]]:
    """(text, start, end, rule) of every span, in bytes of the text; leftmost, longest, without overlaps within a rule."""
    machine, back, kept = made or automata()
    found = []
    for a, b in tb.slices(offsets, 4 << 20):
        part = buf[offsets[a] : offsets[b]]
        own = offsets[a : b + 1] - offsets[a]
        hits, rules = machine.scan(part, own[:-1])
        for rule, kind in enumerate(RULES):
            at = hits[(rules >> rule & 1).astype(bool)]
            if not len(at):
                continue
            at = at[np.append(at[1:] != at[:-1] + 1, True)]  # the last of each row of bytes
            text = np.searchsorted(own, at, "right") - 1
            low = own[text]
            start = back[kind].lasts(part, low, at)
            past, of = 0, -1
            for t, s, e, lo in zip(text.tolist(), start.tolist(), (at + 1).tolist(), low.tolist(), strict=True):
                if t == of and s < past:  # begins within the span before: the leftmost one behind that, if there is one
                    s = int(back[kind].lasts(part, np.array([past]), np.array([e - 1]))[0]) if e > past else -1
                    if s < 0:
                        continue
                past, of = e, t
                if kind not in kept or kept[kind].longest(part[s:e].tobytes(), 0, e - s) == e - s:
                    found.append((a + t, s - lo, e - lo, rule))
    return found


def _points(data: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Byte offsets to code points."""
    if not len(data) or not (data >= 128).any():
        return spans
    return np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[spans]


SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("kind", T.StringType())]))


def _spans(batch_column: pa.Array, made=None) -> list[list[dict]]:
    buf, offsets = tb.text_bytes(batch_column)
    out: list[list[dict]] = [[] for _ in range(len(offsets) - 1)]
    kinds = list(RULES)
    by_text: dict[int, list] = {}
    for t, s, e, r in find(buf, offsets, made):
        by_text.setdefault(t, []).append((s, e, r))
    for t, spans in by_text.items():
        spans.sort(key=lambda x: (x[0], x[2]))
        at = _points(buf[offsets[t] : offsets[t + 1]], np.array([x[:2] for x in spans]))
        out[t] = [{"start": int(s), "end": int(e), "kind": kinds[r]} for (s, e), (_, _, r) in zip(at, spans, strict=True)]
    return out


def scan_secrets(docs: DataFrame, text: str = "text", into: str = "secret_spans") -> DataFrame:
    """docs with `into`: an array of (start, end, kind) for each text, by start and then by the order of RULES."""
    if into in docs.columns:
        docs = docs.drop(into)
    schema = T.StructType([*docs.schema.fields, T.StructField(into, SPAN)])
    at = docs.columns.index(text)
    made = automata()  # a few megabytes, built once
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def scan(batches):
        for batch in batches:
            spans = pa.array(_spans(batch.column(at), made), kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, spans], names=[*batch.schema.names, into])

    return docs.mapInArrow(scan, schema)


def redact_secrets(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of every rule replaced by `mark`, overlapping ones by one; the columns stay as they are."""
    spans = "_spans"
    while spans in docs.columns:
        spans += "_"
    found = scan_secrets(docs, text, spans)
    # what is between the ends so far and the next start, then the mark
    state = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(acc, x):
        gap = F.substring(F.col(text), (acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int"))
        return F.when(x["start"] >= acc["at"], F.struct(F.concat(acc["out"], gap, F.lit(mark)).alias("out"), x["end"].alias("at"))).otherwise(F.struct(acc["out"].alias("out"), F.greatest(acc["at"], x["end"]).alias("at")))

    done = F.aggregate(spans, state, step, lambda acc: F.concat(acc["out"], F.substring(F.col(text), (acc["at"] + 1).cast("int"), F.length(text))))
    new = F.when(F.size(spans) > 0, done).otherwise(F.col(text))
    return found.select(*[new.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])


def secret_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 (over the base kinds' spans) and spans (of all rules)."""
    found = scan_secrets(docs.select("doc_id", "text"))
    shown = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    base = F.filter("secret_spans", lambda x: x["kind"].isin(*BASE))
    count = lambda k: F.size(F.filter("secret_spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, BASE), F.sha2(F.array_join(F.transform(base, shown), ","), 256).alias("base_sha256"), F.array_join(F.transform("secret_spans", shown), ",").alias("spans"))
