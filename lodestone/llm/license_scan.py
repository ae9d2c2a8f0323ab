"""Licence scans by a positional rare-token index.

The index posts words of licence templates with the template and the place in it. A file's words look the postings up, and each hit proposes a start:
its own place less that in the template. A start counts if SHARE of the template's words stand within DRIFT places of their own, and so does the template's mandatory key
phrase; so a word more or less costs no more than itself, in the key phrase as anywhere. Of a key phrase no word may lack without
which it would be another label's ("gnu lesser general public license", "version 3"), and where two templates of different labels hold at one place, and the key words
of one are among those of the other, the longer one stands.

Which words are posted follows from SHARE: as many of a template's words may lack as it leaves over, so of one word more at least one is in the file. The
words of highest inverse document frequency among the templates are posted, just so many of each template. No file is missed for it, a file's labels
depend on the file alone, and the work is that of the postings hit, not words times templates. Base phrases are found in the same index, without tolerance.

Templates are a parameter: a list, or a table read by ``templates_of``. A worker holds the index, whose size is theirs.

Results in special cases: a null or empty text has no words and no labels; very long texts are scanned whole;
repeated rows each get their row; a null id stays null; an empty table gives an
empty result; columns other than the id and the text are never read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from lodestone.llm._common import LOWER, arrow_map, blocks, kept, mapped, ragged, words

#: Base phrases and their labels.
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

#: (label, template, mandatory key phrase within it)
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "permission is hereby granted free of charge to any person"),
    ("mit", "released under the mit license", "the mit license"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache license version 2"),
    ("apache-2", "licensed under the apache license version 2 0", "apache license version 2"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0 international"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("gpl-2", "this work is licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", "gnu affero general public license"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "names of its contributors may be used to endorse or promote products"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "in no event will the authors be held liable for any damages"),
    ("boost", "distributed under the boost software license version 1 0", "boost software license"),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", "eclipse public license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike 4 0 international"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial 4 0 international"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "waived all copyright and related or neighboring rights"),
    ("artistic-2", "licensed under the terms of the artistic license 2 0", "the artistic license 2 0"),
    ("gpl", "licensed under the gnu general public license", "gnu general public license"),
    ("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license", "gnu affero general public license"),
    ("gpl-3", "gnu general public license v3", "gnu general public license v3"),
    ("gpl-3", "gnu gpl v3", "gnu gpl v3"),
    ("gpl-2", "gnu gpl v2", "gnu gpl v2"),
    ("bsd", "the bsd 2 clause license", "bsd 2 clause license"),
    ("bsd", "the bsd 3 clause license", "bsd 3 clause license"),
    ("cc-by", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    ("mpl-2", "mozilla public license version 2 0", "mozilla public license version 2"),
    ("isc", "released under the isc license", "the isc license"),
]

#: Short identifiers that a tag line names, and their labels.
TAGS = {
    "mit": "mit", "apache 2 0": "apache-2", "gpl 2 0": "gpl-2", "gpl 3 0": "gpl-3", "lgpl 2 1": "lgpl", "lgpl 3 0": "lgpl", "agpl 3 0": "agpl", "bsd 2 clause": "bsd", "bsd 3 clause": "bsd", "mpl 2 0": "mpl-2", "isc": "isc",
    "unlicense": "unlicense", "zlib": "zlib", "bsl 1 0": "boost", "epl 2 0": "epl-2", "cc0 1 0": "cc0", "cc by 4 0": "cc-by", "cc by sa 4 0": "cc-by-sa", "cc by nc 4 0": "cc-by-nc", "artistic 2 0": "artistic-2",
}
TEMPLATES += [(label, f"spdx license identifier {tag}", f"identifier {tag}") for tag, label in TAGS.items()]

#: Share of a template's words, and of its key phrase's, that must stand at their places, and how far off a place may be.
SHARE, DRIFT = 0.8, 3

#: Bytes of words: digits, letters in lower case, and all over 127; other bytes are white space.
_WORDS = np.full(256, 32, dtype=np.uint8)
for _b in [*range(48, 58), *range(97, 123), *range(128, 256)]:
    _WORDS[_b] = _b
_WORDS[65:91] = LOWER[65:91]

Template = tuple[str, str, str]


def lacking(n: int) -> int:
    """How many of n words may lack."""
    return n - math.ceil(SHARE * n - 1e-9)


def templates_of(table: DataFrame) -> list[Template]:
    """Templates from a table of them (``label``, ``text``, ``key``), with their words as files' words are taken. A key phrase that is not in its text is an error."""
    rows = table.select("label", "text", "key").toArrow()  # licences, not files
    plain = lambda c: [" ".join(b.decode().split()) for b in mapped(pc.fill_null(rows.column(c).combine_chunks().cast(pa.string()), ""), _WORDS).cast(pa.binary()).to_pylist()]
    found = list(zip(rows.column("label").to_pylist(), plain("text"), plain("key"), strict=True))
    for label, text, key in found:
        if not key or f" {key} " not in f" {text} ":
            raise ValueError(f"the key phrase of a template of {label} isn't in it")
    return sorted(set(found))


class Index:
    """Postings, key phrases and base phrases as word numbers."""

    def __init__(self, templates: Sequence[Template] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES):
        # base phrases come last, as templates of which no word may lack or stray
        rows = [(label, t.split(), k.split()) for label, t, k in templates] + [(label, p.split(), p.split()) for p, label in phrases]
        self.vocabulary = sorted({w for _, t, _ in rows for w in t})
        self.n_templates = len(templates)
        self.labels = [r[0] for r in rows]
        number = {w: k for k, w in enumerate(self.vocabulary)}
        files = Counter(w for _, t, _ in rows for w in set(t))
        self.idf = np.array([math.log(len(rows) / files[w]) for w in self.vocabulary])
        self.words = [np.array([number[w] for w in t]) for _, t, _ in rows]
        self.before = [next(i for i in range(len(t)) if t[i : i + len(k)] == k) for _, t, k in rows]
        self.key = [np.array([number[w] for w in k]) for _, _, k in rows]
        self.must = [np.zeros(len(k), dtype=bool) for _, _, k in rows]
        self.longer: list[list[int]] = [[] for _ in rows]
        keys = [set(k.tolist()) for k in self.key[: self.n_templates]]
        holding: list[list[int]] = [[] for _ in self.vocabulary]
        for j, own in enumerate(keys):
            for w in own:
                holding[w].append(j)
        for i, own in enumerate(keys):
            shared = Counter(j for w in own for j in holding[w])  # other keys with some of its words
            for j in sorted(shared):
                if self.labels[i] != self.labels[j]:
                    differ = np.array([w not in keys[j] for w in self.key[i].tolist()])
                    if differ.sum() <= lacking(len(differ)):
                        self.must[i] |= differ
                    if shared[j] == len(own) < len(keys[j]):
                        self.longer[i].append(j)
        posts = []  # (word, template, place): of each template one word more than may lack
        for k, ws in enumerate(self.words):
            most = lacking(len(ws)) if k < self.n_templates else 0
            posts += [(ws[i], k, i) for i in np.argsort(-self.idf[ws], kind="stable")[: most + 1].tolist()]
        posts.sort()
        self.posted = np.array([p[1:] for p in posts])
        ends = np.cumsum(np.bincount([p[0] for p in posts], minlength=len(self.vocabulary)))
        self.first, self.count = np.concatenate(([0], ends[:-1])), np.diff(np.concatenate(([0], ends)))
        self.table = pa.array(self.vocabulary)

    def numbers(self, distinct: pa.Array) -> np.ndarray:
        """The vocabulary's number of each distinct word, or -1."""
        return pc.fill_null(pc.index_in(distinct, self.table), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def starts(self, number: np.ndarray, at: np.ndarray, owner: np.ndarray) -> list[np.ndarray]:
        """For each template the starts that the files' words propose, each once and within the drift of its text. ``at`` has each text's first word, and the end."""
        hit = np.flatnonzero((number >= 0) & (self.count[number] > 0))
        posts = ragged(self.first[number[hit]], self.count[number[hit]])
        template, place = self.posted[posts, 0], self.posted[posts, 1]
        word = np.repeat(hit, self.count[number[hit]])
        start = word - place
        # a start in front of its text belongs to it still: it is told by the text's number
        text = owner[word]
        local = start - at[text]
        order = np.lexsort((local, text, template))
        template, text, local = template[order], text[order], local[order]
        new = np.ones(len(template), dtype=bool)
        new[1:] = (template[1:] != template[:-1]) | (text[1:] != text[:-1]) | (local[1:] != local[:-1])
        bounds = np.searchsorted(template[new], np.arange(len(self.words) + 1))
        both = np.stack([text[new], local[new]], axis=1)
        return [both[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def standing(self, words_: np.ndarray, offset: int, found: np.ndarray, number: np.ndarray, at: np.ndarray, drift: int = DRIFT) -> np.ndarray:
        """For each start and word, whether it stands within the drift of its place."""
        out = np.zeros((len(found), len(words_)), dtype=bool)
        low, high = at[found[:, 0]], at[found[:, 0] + 1]
        for k, w in enumerate(words_.tolist()):
            here = low + found[:, 1] + offset + k
            for d in range(-drift, drift + 1):
                place = here + d
                out[:, k] |= (place >= low) & (place < high) & (number[np.clip(place, 0, len(number) - 1)] == w)
        return out

    def matches(self, number: np.ndarray, at: np.ndarray, owner: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[np.ndarray]]:
        """For each template its verified (text, start) and their shares; for each base phrase its (text, start)."""
        found = self.starts(number, at, owner)
        verified: list[tuple[np.ndarray, np.ndarray]] = []
        for k in range(self.n_templates):
            some = found[k]
            if len(some):
                key = self.standing(self.key[k], self.before[k], some, number, at)
                some = some[((~key).sum(axis=1) <= lacking(key.shape[1])) & key[:, self.must[k]].all(axis=1)]
            share = self.standing(self.words[k], 0, some, number, at).sum(axis=1) / len(self.words[k]) if len(some) else np.zeros(0)
            verified.append((some[share >= SHARE - 1e-9], share[share >= SHARE - 1e-9]))
        out = []
        for k, (some, share) in enumerate(verified):
            keep = np.ones(len(some), dtype=bool)
            for j in self.longer[k]:
                other = verified[j][0]
                if len(other) and len(some):
                    mine, theirs = some[:, 1] + self.before[k], other[:, 1] + self.before[j]
                    # a text's places, wide apart from the next one's
                    wide = int(max(mine.max(), theirs.max()) - min(mine.min(), theirs.min())) + 4 * DRIFT + 1
                    line = np.sort(other[:, 0] * wide + theirs)
                    near = np.searchsorted(line, some[:, 0] * wide + mine - 2 * DRIFT)
                    keep &= ~((near < len(line)) & (line[np.minimum(near, len(line) - 1)] <= some[:, 0] * wide + mine + 2 * DRIFT))
            out.append((some[keep], share[keep]))
        base = []
        for k in range(self.n_templates, len(self.words)):
            some = found[k]
            base.append(some[self.standing(self.words[k], 0, some, number, at, 0).all(axis=1)] if len(some) else some)
        return out, base


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """Per row: the id, ``n_words``, ``n_base`` places of base phrases, ``first_word`` and ``last_word`` (their smallest and largest start),
    ``base_labels``, ``labels`` (base and templates', sorted, comma-joined) and ``score``, the largest share of a template or base phrase found."""
    templates = list(templates)

    def run(batches):
        index = kept(f"licences {hash(tuple(templates))}", lambda: Index(templates))
        for block in blocks(batches, 1):
            codes, at, distinct = words(mapped(block.column(1), _WORDS))
            number = index.numbers(distinct)[codes] if len(codes) else np.zeros(0, dtype=np.int64)
            n = block.num_rows
            owner = np.repeat(np.arange(n), np.diff(at))
            base: list[set[str]] = [set() for _ in range(n)]
            n_base, first, last = np.zeros(n, dtype=np.int64), np.full(n, 2**62), np.full(n, -1)
            of_templates, of_phrases = index.matches(number, at, owner)
            for some, label in zip(of_phrases, index.labels[index.n_templates :], strict=True):
                own, local = some[:, 0], some[:, 1]
                np.add.at(n_base, own, 1)
                np.minimum.at(first, own, local)
                np.maximum.at(last, own, local)
                for i in np.unique(own).tolist():
                    base[i].add(label)
            labels, score = [set(b) for b in base], (n_base > 0).astype(np.float64)
            for (some, share), label in zip(of_templates, index.labels[: index.n_templates], strict=True):
                np.maximum.at(score, some[:, 0], share)
                for i in np.unique(some[:, 0]).tolist():
                    labels[i].add(label)
            join = lambda sets: pa.array([",".join(sorted(s)) for s in sets], pa.string())
            some = n_base > 0
            yield pa.RecordBatch.from_arrays(
                [block.column(0), pa.array(np.diff(at)), pa.array(n_base), pa.array(first, mask=~some), pa.array(last, mask=~some), join(base), join(labels), pa.array(score)],
                names=[id_col, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    return arrow_map(df, [id_col, text_col], run, f"{id_col} {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def oracle() -> str:
    """DuckDB SQL for the rows of ``scan`` over ``documents``: every start at which one of a template's posted words stands in its place, verified word by word."""
    index = Index()
    text = lambda k: "[" + ", ".join(f"'{index.vocabulary[w]}'" for w in k) + "]"
    phrases = ", ".join(f"({text(p)}, '{label}')" for p, label in zip(index.words[index.n_templates :], index.labels[index.n_templates :], strict=True))
    rows = []
    for k in range(index.n_templates):
        posted = sorted(i for t, i in index.posted.tolist() if t == k)
        must = index.key[k][index.must[k]]
        rows.append(f"({k}, '{index.labels[k]}', {text(index.words[k])}, {[i + 1 for i in posted]}, {text(index.key[k])}, {index.before[k]}, {lacking(len(index.key[k]))}, {text(must) if len(must) else '[]::VARCHAR[]'}, {index.longer[k] or '[]::INTEGER[]'})")
    upper, lower = ("".join(chr(c + k) for k in range(26)) for c in (65, 97))
    at = "list_contains(list_slice(w, greatest(1, start + {o} + k - {d}), greatest(0, start + {o} + k + {d})), {of}[k])"
    held = lambda of, o: f"list_filter(range(1, len({of}) + 1), lambda k: {at.format(of=of, o=o, d=DRIFT)})"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
w AS (SELECT *, ' ' || array_to_string(w, ' ') || ' ' AS joined, list_distinct(w) AS own FROM d),
p(ph, label) AS (VALUES {phrases}),
t(k_, label, t, posted, key, before, lack, must, longer) AS (VALUES {", ".join(rows)}),
base AS (SELECT rid, i, label FROM p, w, unnest(range(1, len(w) - len(ph) + 2)) r(i) WHERE contains(joined, ' ' || array_to_string(ph, ' ') || ' ') AND list_slice(w, i, i + len(ph) - 1) = ph),
likely AS (SELECT * FROM t, w WHERE len(list_intersect(list_distinct(key), own)) + lack >= len(list_distinct(key)) AND len(list_intersect(list_distinct(t), own)) > 0),
proposed AS (SELECT DISTINCT rid, k_, i - q AS start FROM likely, unnest(posted) u(q), unnest(range(1, len(w) + 1)) r(i) WHERE w[i] = t[q]),
checked AS (SELECT rid, k_, label, start, before, longer, {held('key', 'before')} AS stood, {held('t', '0')} AS standing, key, t, lack, must FROM proposed JOIN likely USING (rid, k_)),
verified AS (SELECT rid, k_, label, start + before AS place, longer, len(standing)::DOUBLE / len(t) AS share FROM checked
  WHERE len(key) - len(stood) <= lack AND list_has_all(list_transform(stood, lambda k: key[k]), must) AND len(standing)::DOUBLE / len(t) >= {SHARE} - 1e-9),
shares AS (SELECT rid, label, share FROM verified v WHERE NOT EXISTS (SELECT 1 FROM verified o WHERE o.rid = v.rid AND list_contains(v.longer, o.k_) AND abs(o.place - v.place) <= {2 * DRIFT})),
b AS (SELECT rid, count(*) AS n, min(i) - 1 AS low, max(i) - 1 AS high, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM base GROUP BY rid),
a AS (SELECT rid, max(share) AS share, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT rid, label, share FROM shares UNION ALL SELECT rid, label, 1.0 FROM base) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(b.n, 0)::BIGINT AS n_base, b.low::BIGINT AS first_word, b.high::BIGINT AS last_word, coalesce(b.labels, '') AS base_labels, coalesce(a.labels, '') AS labels, coalesce(a.share, 0.0)::DOUBLE AS score
FROM w LEFT JOIN b USING (rid) LEFT JOIN a USING (rid)"""
