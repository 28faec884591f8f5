"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import re
import zlib

LOWER = {i: i + 32 for i in range(65, 91)}
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_scores(rows):
    """{doc_id: (held out, tokens, known, N, base)}"""
    tokens = {i: [*SPACED.findall((t or "").translate(LOWER)), "\x00 end"] for i, t in rows}
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    counts = collections.Counter(w for i, ws in tokens.items() if not out[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    return {i: (out[i], len(ws), sum(counts[w] > 0 for w in ws), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)) for i, ws in tokens.items()}


def contamination(rows, items, n=10):
    words = lambda t: ALNUM.findall((t or "").translate(LOWER))
    windows = collections.defaultdict(set)
    for item, text in items:
        w = words(text)
        for k in range(max(1, len(w) - n + 1) if w else 0):
            windows[tuple(w[k : k + n])].add(str(item))
    out = []
    for i, text in rows:
        w, hit, found = words(text), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if (x := tuple(w[k : k + size])) in windows:
                    hit |= set(range(k, k + size))
                    found |= windows[x]
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def personal(text):
    out = []
    for rank, (kind, pattern) in enumerate(PII.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), rank, m.end(), kind))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def luhn(digits):
    twice = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in twice) % 10 == 0


def quality(text):
    words = SPACED.findall(text or "")
    lines = [x for x in (text or "").split("\n") if SPACED.search(x)]
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    counts = collections.Counter(windows)
    repeated = {k + j for k, w in enumerate(windows) if counts[w] > 1 for j in range(3)}
    failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeated), failed


def conversation(turns):
    """(n, sha, loss characters, loss sha) of [(turn, role, text)]"""
    turns = sorted((t, r or "", x or "") for t, r, x in turns)
    loss = "".join(x for _, r, x in turns if r == "assistant")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(loss), sha(loss)


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def groups(n, linked):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a in range(n):
        for b in range(a):
            if linked(a, b):
                parent[find(a)] = find(b)
    return [find(x) for x in range(n)]


def trie(rows, share=None):
    """{prefix: (smallest member, depth, parent's, members, children, leaves, saved, ends)} of (conv_id, turn, role, text)"""
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4 if share and c is not None else 0
        built[c] = tuple((own.get(c - c % share, []) if share and c is not None else [])[:h] + turns[h:])
    members = collections.defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    least = lambda cs: None if None in cs else min(cs)
    children = collections.defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)

    def under(p):
        todo, out = [p], []
        while todo:
            out.append(todo.pop())
            todo += children[out[-1]]
        return out

    out = {}
    for p, cs in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in cs if c is not None and built[c] == p))
        saved = sum((len(members[q]) - 1) * len(SPACED.findall(q[-1][1])) for q in under(p) if q)
        leaves = sum(not children[q] for q in under(p))
        out[p] = (least(cs), len(p), least(members[p[:-1]]) if p else None, len(cs), len(children[p]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest())
    return out


def filter_masks(rows):
    """The set of failed filters of each of (doc_id, text)"""
    least = {}
    for i, text in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    out = []
    for i, text in rows:
        text = text or ""
        words = SPACED.findall(text)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and i > least[text]}
        out.append({k for k, v in fails.items() if v})
    return out


def filter_audit(failed):
    """{(order, step): (kept, removed, redundant, unique, good lost, toxic lost, shapley)} of one part's (failed filters, good, toxic)"""
    out, by_filter = {}, collections.Counter()
    for order in map("".join, itertools.permutations("ABCDE")):
        left = list(failed)
        for step, f in enumerate(order, 1):
            gone = [x for x in left if f in x[0]]
            left = [x for x in left if f not in x[0]]
            earlier = sum(f in x[0] for x in failed) - sum(f in x[0] for x in gone)
            out[order, step] = (len(left), len(gone), earlier, sum(x[0] == {f} for x in failed), sum(x[1] for x in gone), sum(x[2] for x in gone))
            by_filter[f] += len(gone)
    return {k: (*v, by_filter[k[0][k[1] - 1]]) for k, v in out.items()}


def suffix_tree(rows, p_symbol, p_context, p_pair, threshold):
    """({doc_id: score}, kept contexts by length) of a suffix tree of contexts of any length, one dictionary a context."""
    tokens = {i: [*SPACED.findall((t or "").translate(LOWER)), "\x00 end"] for i, t in rows}
    train = [ws for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    counts = collections.Counter(w for ws in train for w in ws)
    n, v = sum(counts.values()), len(counts)
    own = {w for w, c in counts.items() if c >= max(2, n * p_symbol)}
    root = {w: (counts[w] + 1) / (n + v + 1) for w in own}
    root[None] = 1 - sum(root.values())
    least_context, least_pair = max(4, n * p_context), max(2, n * p_pair)
    texts = [[w if w in own else None for w in ws] for ws in train]
    kept = {}

    def state(history):
        return next((history[-k:] for k in range(len(history), 0, -1) if history[-k:] in kept), ())

    def gain(at, symbol):
        weight = 1.0
        while at:
            known, other = kept[at]
            if symbol in known:
                return weight * known[symbol]
            weight, at = weight * other, state(at[1:])
        return weight

    level = {(w,) for w in own if counts[w] >= least_context and w != "\x00 end"}
    while level:
        size, after = len(next(iter(level))), collections.defaultdict(collections.Counter)
        for t in texts:
            for k in range(size, len(t)):
                if (c := tuple(t[k - size : k])) in level:
                    after[c][t[k]] += 1
        found = {}
        for c, nexts in after.items():
            total, kinds, below = sum(nexts.values()), len(nexts), state(c[1:])
            often = {s: m for s, m in nexts.items() if m >= least_pair}
            other = (kinds + total - sum(often.values())) / (total + kinds)
            p = {s: m / (total + kinds) + other * gain(below, s) * root[s] for s, m in often.items()}
            rest = max(1 - sum(p.values()), 1e-300)
            divergence = sum(x * math.log(x / (gain(below, s) * root[s])) for s, x in p.items()) + rest * math.log(max(other, 1e-300))
            if divergence >= threshold:
                found[c] = ({s: x / root[s] for s, x in p.items()}, other)
        kept |= found
        level = {(*c, s) for c, nexts in after.items() for s, m in nexts.items() if m >= least_context and s not in (None, "\x00 end")} if found else set()
    base = base_scores(rows)
    scores = {}
    for i, ws in tokens.items():
        symbols = [w if w in own else None for w in ws]
        scores[i] = base[i][4] + sum(math.log10(gain(state(tuple(symbols[max(0, k - 30) : k])), s)) for k, s in enumerate(symbols))
    return scores, collections.Counter(map(len, kept))
