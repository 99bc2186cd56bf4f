"""License scans: an Aho-Corasick automaton finds notice phrases and identifier tags in one pass over a text's words,
and a shunting-yard parser reads the and/or/with expressions behind the tags.

Narrow: a row is judged by itself, whole text, nothing is shuffled. A null text is empty. A tag whose expression can't
be parsed gives the label 'invalid-expression' and no other.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from toolweave.llm.common import alnum_words, small_batches, table, utf8, without

# Fixed phrases (words joined by spaces) and labels.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
NOTICES = {
    "all rights reserved": "all-rights-reserved",
    "bsd 2 clause license": "bsd-2-clause",
    "bsd 3 clause license": "bsd-3-clause",
    "cc by sa": "cc-by-sa",
    "cc0 1 0 universal": "cc0",
    "creative commons attribution": "cc-by",
    "dedicated to the public domain": "public-domain",
    "gnu affero general public license": "agpl",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "mozilla public license": "mpl",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "this is free and unencumbered software": "unlicense",
}
TAG = "spdx license identifier"
TAG_LINE = re.compile(r"spdx-license-identifier\s*:[ \t]*([^\r\n]*)", re.IGNORECASE)
PERMISSIVE = {"mit", "apache-2", "bsd", "bsd-2-clause", "bsd-3-clause", "cc0", "cc-by", "public-domain", "unlicense", "isc", "zlib", "0bsd"}
# How far one finding of each kind goes towards certainty.
TAG_WEIGHT, BASE_WEIGHT, NOTICE_WEIGHT = 0.9, 0.7, 0.5

TOKEN = re.compile(r"\s*(\(|\)|[A-Za-z0-9.+:-]+)")
BINDS = {"or": 1, "and": 2, "with": 3}
OUTPUTS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "expressions", "permissive")


def label_of(identifier: str) -> str:
    """A label for a license identifier: lower case, without -only, -or-later, + and a version's .0."""
    x = identifier.lower().rstrip("+")
    for end in ("-only", "-or-later"):
        x = x.removesuffix(end)
    if x.startswith("cc-by"):
        x = re.sub(r"-\d.*$", "", x)
    elif x.startswith("cc0"):
        x = "cc0"
    elif x.startswith(("gpl-", "lgpl-", "agpl-", "mpl-")):
        x = x.split("-")[0]
    return re.sub(r"\.0$", "", x)


def postfix(expression: str) -> list[str] | None:
    """An expression's tokens in postfix order, or None if it is not well formed."""
    out: list[str] = []
    stack: list[str] = []
    at, operand = 0, True  # operand: one is due
    expression = expression.strip().rstrip("*/->").strip()
    while at < len(expression):
        m = TOKEN.match(expression, at)
        if not m:
            return None
        token, at = m[1], m.end()
        if token == "(":
            if not operand:
                return None
            stack.append(token)
        elif token == ")":
            if operand:
                return None
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        elif token.lower() in BINDS:
            if operand:
                return None
            token = token.lower()
            while stack and stack[-1] != "(" and BINDS[stack[-1]] >= BINDS[token]:
                out.append(stack.pop())
            stack.append(token)
            operand = True
        else:
            if not operand:
                return None
            out.append(token)
            operand = False
    if operand:
        return None
    while stack:
        if stack[-1] == "(":
            return None
        out.append(stack.pop())
    return out


def evaluate(tokens: list[str], allowed=PERMISSIVE) -> tuple[bool, set[str]]:
    """Whether the postfix expression can be met by allowed licenses alone, and the labels that it names."""
    stack: list[tuple[bool, set[str]]] = []
    for token in tokens:
        if token not in BINDS:
            name = label_of(token)
            stack.append((name in allowed, {name}))
            continue
        b, a = stack.pop(), stack.pop()
        if token == "with":  # an exception widens its license and is no license
            stack.append(a)
        else:
            stack.append((a[0] or b[0] if token == "or" else a[0] and b[0], a[1] | b[1]))
    return stack[0]


_automaton = None


def automaton():
    global _automaton
    if _automaton is None:
        import ahocorasick

        made = ahocorasick.Automaton()
        for phrase, label in {**NOTICES, **BASE, TAG: None}.items():
            made.add_word(f" {phrase} ", (len(phrase) + 2, label, phrase in BASE))
        made.make_automaton()
        _automaton = made
    return _automaton


def scan_text(data: bytes | None) -> tuple:
    """The values of OUTPUTS for one UTF-8 text."""
    words = alnum_words(data)
    line = (b" " + b" ".join(words) + b" ").decode("latin-1")
    base, notices, tags, starts = set(), set(), 0, []
    doubt = 1.0
    for end, (size, label, is_base) in automaton().iter(line):
        if label is None:
            tags += 1
        elif is_base:
            base.add(label)
            starts.append(end - size + 1)
            doubt *= 1 - BASE_WEIGHT
        else:
            notices.add(label)
            doubt *= 1 - NOTICE_WEIGHT
    expressions, permissive, tagged = [], [], set()
    if tags:
        for m in TAG_LINE.finditer(data.decode("utf-8", "replace")):
            tokens = postfix(m[1])
            if tokens is None:
                notices.add("invalid-expression")
                continue
            met, named = evaluate(tokens)
            expressions.append(m[1].strip())
            permissive.append(met)
            tagged |= named - notices
            notices |= named
            doubt *= 1 - TAG_WEIGHT
    first = last = None
    if starts:
        first, last = (line.count(" ", 0, x) for x in (min(starts), max(starts)))
    labels = base | notices
    said = base | (notices - tagged)
    verdict = all(permissive) and said <= PERMISSIVE if said or permissive else None
    return (len(words), len(starts), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), round(1 - doubt, 6), expressions, verdict)


def scan(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with OUTPUTS: word counts, places of base phrases, labels, score, tag expressions, and whether all that is
    said can be met by permissive licenses (null where nothing is said). Columns named like an output are replaced."""
    kinds = [T.LongType()] * 4 + [T.StringType()] * 2 + [T.DoubleType(), T.ArrayType(T.StringType()), T.BooleanType()]

    @F.arrow_udf(T.StructType([T.StructField(n, k) for n, k in zip(OUTPUTS, kinds)]))
    def each(text):
        import pyarrow as pa

        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.string()), pa.bool_()]
        columns = list(zip(*map(scan_text, utf8(text)))) or [()] * len(OUTPUTS)
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], list(OUTPUTS))

    small_batches(docs.sparkSession)
    docs = without(docs, *(n for n in OUTPUTS if n != text_col))
    names = docs.columns
    return docs.withColumn("__scan", each(F.col(text_col))).select(*[F.col(f"`{c}`") for c in names], "__scan.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
