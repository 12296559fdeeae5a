"""Plain versions of the operators, straight from their definitions, for small tables."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def quality(rows):
    """doc_id -> n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed"""
    out = {}
    for doc_id, text in rows:
        text = text or ""
        words = WORD.findall(text)
        seen, dup = set(), 0
        for line in text.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        times = Counter(windows)
        cover = {j for i, w in enumerate(windows) if times[w] > 1 for j in range(i, i + 5)}
        n = len(words)
        out[doc_id] = (n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(cover), n < 10 or 100 * len(cover) > 20 * n)
    return out


def substring(rows, width=35):
    """doc_id -> n_words, n_removed, kept_sha256"""
    words = {d: WORD.findall(t or "") for d, t in rows}
    times = Counter(tuple(w[i : i + width]) for w in words.values() for i in range(len(w) - width + 1))
    out = {}
    for d, w in words.items():
        gone = {j for i in range(len(w) - width + 1) if times[tuple(w[i : i + width])] > 1 for j in range(i, i + width)}
        out[d] = (len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone).encode()))
    return out


def suffix(rows, width=50):
    """doc_id -> n_bytes, n_removed, n_spans, kept_sha256"""
    raw = {d: (t or "").encode() for d, t in rows}
    first = {}
    for d in sorted(raw):
        for i in range(len(raw[d]) - width + 1):
            first.setdefault(raw[d][i : i + width], d)
    out = {}
    for d, b in raw.items():
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if first[b[i : i + width]] < d:
                gone[i : i + width] = b"\x01" * width
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out[d] = (len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g)))
    return out


def shingles(text, width):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < width:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def near(rows, width=4, percent=80):
    """doc_id -> n_shingles, component_id, kept"""
    sets = {d: shingles(t, width) for d, t in rows}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            by[x].append(d)
    shared = Counter((a, b) for ds in by.values() for k, a in enumerate(sorted(ds)) for b in sorted(ds)[k + 1 :])
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {d: (len(s), root(d), root(d) == d) for d, s in sets.items()}


def personal(text):
    """The patterns' spans by kind and start."""
    text = text or ""
    luhn = lambda d: sum(x if k % 2 == 0 else (2 * x - 9 if 2 * x > 9 else 2 * x) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def trie(rows):
    """(conv_id, turn, role, text) rows -> sorted rows of the trie's nodes"""
    import zlib

    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", sha((text or "").encode()), text or ""))
    turns = {c: [(x[2], x[4]) for x in sorted(xs)] for c, xs in own.items()}
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, xs in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        seq = tuple(turns.get(base, [])[:h] + xs[h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
            if d:
                kids[seq[: d - 1]].add(seq[:d])
        ends[seq].append(c)
    leaves, saved = Counter(), Counter()
    for s, cs in members.items():
        for d in range(len(s) + 1):
            leaves[s[:d]] += s not in kids
            saved[s[:d]] += (len(cs) - 1) * len(WORD.findall(s[-1][1])) if s else 0
    return sorted((min(cs), len(s), min(members[s[:-1]]) if s else None, len(cs), len(kids.get(s, ())), leaves[s], saved[s], sha(",".join(map(str, sorted(ends.get(s, [])))).encode())) for s, cs in members.items())


def language_model(rows, order, held=1):
    """doc_id -> held_out, n_tokens, n_known, train_tokens, base_score, score; from (doc_id, text)"""
    import math
    import zlib

    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    toks = lambda t: [*WORD.findall(low(t)), "</s>"]
    is_held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == held
    top, raw = Counter(), Counter()
    for d, t in rows:
        if not is_held(d):
            w = ["<s>"] * (order - 1) + toks(t)
            raw.update(w[order - 1 :])
            top.update(tuple(w[i : i + order]) for i in range(len(w) - order + 1))
    used = {order: top}
    for m in range(order - 1, 0, -1):
        used[m] = Counter(g[1:] for g in used[m + 1])
    disc, follow = {}, {}
    for m, cs in used.items():
        n = [sum(c == k for c in cs.values()) for k in (1, 2, 3, 4)]
        ds = (0.5, 1.0, 1.5)
        if all(n):
            y = n[0] / (n[0] + 2 * n[1])
            got = tuple(k + 1 - (k + 2) * y * n[k + 1] / n[k] for k in range(3))
            ds = got if all(0 <= x <= k + 1 for k, x in enumerate(got)) else ds
        disc[m], follow[m] = ds, defaultdict(lambda: [0, 0])
        for g, c in cs.items():
            follow[m][g[:-1]][0] += c
            follow[m][g[:-1]][1] += ds[min(c, 3) - 1]
    v = len(raw)

    def prob(ctx, w):
        p = 1 / (v + 1)
        for m in range(1, order + 1):
            c = ctx[len(ctx) - (m - 1) :]
            after = follow[m].get(c)
            if after:
                own = used[m][(*c, w)]
                p = (own - (disc[m][min(own, 3) - 1] if own else 0) + after[1] * p) / after[0]
        return p

    n = sum(raw.values())
    out = []
    for d, t in rows:
        w = ["<s>"] * (order - 1) + toks(t)
        score = sum(math.log10(prob(tuple(w[i - order + 1 : i]), w[i])) for i in range(order - 1, len(w)))
        own = w[order - 1 :]
        out.append((d, is_held(d), len(own), sum(raw[x] > 0 for x in own), n, sum(math.log10((raw[x] + 0.5) / (n + 0.5 * (v + 1))) for x in own), score))
    return out, prob, set(raw)
