"""Plain versions of the training operators, for small tables."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", text or "")


def ids_of(text, name, end):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return [*t.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def lm(texts: dict, order: int = 3, discount: float = 0.75):
    """Base and model scores by id, from dictionaries of counts."""
    tokens = {d: [*words((t or "").translate(LOWER)), "</s>"] for d, t in texts.items()}
    train = [d for d in tokens if zlib.crc32(str(d).encode()) % 7 != 2]
    c = {k: Counter() for k in range(1, order + 1)}
    for d in train:
        s = ["</s>", *tokens[d]]
        for k in c:
            for i in range(max(1, k - 1), len(s)):
                c[k][tuple(s[i - k + 1 : i + 1])] += 1
    n, v, level = sum(c[1].values()), len(c[1]), {}
    for k in range(2, order + 1):
        total, p, mass = Counter(), {}, Counter()
        for g, m in c[k].items():
            if k == 2 or g[:-1] in level[k - 1][0]:
                total[g[:-1]] += m
        for g, m in c[k].items():
            if g[:-1] in total:
                p[g] = 10 ** (-min(255, math.ceil(-math.log10((m - discount) / total[g[:-1]]) * 20 - 1e-12)) / 20)
                mass[g[:-1]] += p[g]
        level[k] = p, {x: 10 ** (-min(255, max(0, round(-math.log10(min(1, max(1e-4, 1 - mass[x]))) * 64))) / 64) for x in total}
    out = {}
    for d, t in tokens.items():
        s, base, score = ["</s>", *t], 0.0, 0.0
        for i in range(1, len(s)):
            q = (c[1][s[i],] + 1) / (n + v + 1)
            base += math.log10(q)
            for k in range(2, order + 1):
                if i >= k - 1:
                    x = tuple(s[i - k + 1 : i])
                    q = level[k][0].get((*x, s[i]), 0) + level[k][1].get(x, 1) * q
            score += math.log10(q)
        out[d] = len(t), sum(c[1][w,] > 0 for w in t), n, base, score
    return out


def alignment(texts: list, a_path: str = "byte_bpe_50k.json", b_path: str = "piece_bpe_32k.model"):
    """For each text: tokens of both sides, groups written out, links; and the counts of linked pairs."""
    import sentencepiece

    a, b = Tokenizer.from_file(public_tokenizers.path(a_path)), sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(b_path))
    a.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(x): x for x in shown} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in shown)}
    out, counts = [], Counter()
    for text in texts:
        e = a.encode(" " + (text or ""), add_special_tokens=False)
        x = [(i, bytes(chars[c] for c in t)) for i, t in zip(e.ids, e.tokens, strict=True)]
        y = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i in b.encode(text or "") for p in [b.id_to_piece(i)]]
        whole = (" " + (text or "")).encode()
        if not text or b"".join(t for _, t in x) != whole or b"".join(t for _, t in y) != whole:
            out.append((0, 0, "", []))
            continue
        spans = []
        for side in (x, y):
            at = 0
            spans.append([])
            for i, t in side:
                spans[-1].append((i, at, at + len(t)))
                at += len(t)
        links = [(i, j) for i, s, e in spans[0] for j, u, v in spans[1] if s < v and u < e] if len(whole) < 2000 else _links(*spans)
        counts.update(links)
        ends = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        parts, m, n = [], 0, 0
        for cut in ends:
            got = [], []
            while m < len(x) and spans[0][m][2] <= cut:
                got[0].append(str(spans[0][m][0]))
                m += 1
            while n < len(y) and spans[1][n][2] <= cut:
                got[1].append(str(spans[1][n][0]))
                n += 1
            parts.append(",".join(got[0]) + "|" + ",".join(got[1]))
        out.append((len(x), len(y), ";".join(parts), links))
    return out, counts


def _links(x, y):
    out, k = [], 0
    for i, s, e in x:
        while k and y[k - 1][2] > s:
            k -= 1
        while y[k][2] <= s:
            k += 1
        m = k
        while m < len(y) and y[m][1] < e:
            out.append((i, y[m][0]))
            m += 1
    return out


def personal(text) -> list[tuple[str, int, int]]:
    """Spans of the base kinds by plain patterns."""
    text, out = text or "", []
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0
    for k, (kind, pattern) in enumerate({
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }.items()):
        for m in re.finditer(pattern, text):
            digits = "".join(c for c in m[0] if c in "0123456789")
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)) or kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, kind, m.end()))
    return [(kind, s, e) for s, _, kind, e in sorted(out)]
