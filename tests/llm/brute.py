"""Plain versions of the contracts, one row at a time, to hold the operators against."""
from __future__ import annotations

import hashlib
import itertools
import re
import zlib
from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def tokenizer() -> Tokenizer:
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.no_truncation()
    t.no_padding()
    return t


def warc(pages):
    first = {}
    for k, _, html in pages:
        p = (html or "").encode()
        if len(p) >= 100 and k is not None:
            first[p] = min(first.get(p, k), k)
    for k, _, html in pages:
        p = (html or "").encode()
        r = first.get(p)
        again = r is not None and r != k
        yield k, len(p), hashlib.sha256(p).hexdigest(), "revisit" if again else "response", r if again else None


def bpe(docs):
    t = tokenizer()
    for k, text in docs:
        ids = t.encode(text or "", add_special_tokens=False).ids
        yield k, len(ids), sha(",".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))


def token_files(docs, end_id=2):
    t, start = tokenizer(), 0
    for k, text in sorted(docs, key=lambda r: (r[0] is not None, r[0])):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, end_id]
        yield k, start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
        start += len(ids)


def decontaminate(docs, items, size=10):
    item_words = {i: ITEM_WORD.findall((t or "").translate(LOWER)) for i, t in items}
    for k, text in docs:
        w = ITEM_WORD.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for i, iw in item_words.items():
            n = min(size, len(iw))
            windows = {tuple(iw[j: j + n]) for j in range(len(iw) - n + 1)} if n else ()
            for j in range(len(w) - n + 1) if n else ():
                if tuple(w[j: j + n]) in windows:
                    hit.update(range(j, j + n))
                    found.add(str(i))
        yield k, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)


def shards(docs, n=8):
    """The least possible largest shard for atoms in the operator's order, given as (key, size)."""
    order = sorted(docs)
    atoms = [sum(s for _, s in g) for _, g in itertools.groupby(order, key=lambda r: r[0])]
    def need(c):
        used, load = 1, 0
        for a in atoms:
            if load + a > c:
                used, load = used + 1, 0
            load += a
        return used
    low, high = max(atoms), sum(atoms)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if need(mid) <= n else (mid + 1, high)
    return low


def shingles(text):
    w = SPACE_WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i: i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def jaccard(docs):
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))
    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, j in itertools.combinations(range(len(docs)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(docs):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    for i, (k, _) in enumerate(docs):
        yield k, len(sets[i]), least.get(find(i)) if sets[i] else k


def quality(docs):
    for k, text in docs:
        t = text or ""
        w = SPACE_WORD.findall(t)
        windows = Counter(tuple(w[i: i + 3]) for i in range(len(w) - 2))
        covered = {i + o for i in range(len(w) - 2) if windows[tuple(w[i: i + 3])] > 1 for o in range(3)}
        lines = [x for x in t.split("\n") if SPACE_WORD.search(x)]
        bad = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        yield k, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), bad


KINDS = (("assign", re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 1, 6),
         ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile(r"[0-9a-f]+"), 0, 24))


def secrets(docs):
    for k, text in docs:
        found = sorted((m.start(), rank, m.end(), name) for rank, (name, p, g, least) in enumerate(KINDS)
                       for m in p.finditer(text or "") if len(m.group(g)) >= least)
        n = Counter(f[3] for f in found)
        yield k, n["assign"], n["access"], n["hex"], sha(",".join(f"{name}:{a}:{b}" for a, _, b, name in found))


def urls(pages, rules):
    for k, url in pages:
        at = (url or "").find("://")
        rest = url[at + 3:] if at >= 0 else ""
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host):]).group()
        host = host.translate(LOWER)
        fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, 0, None, "allow"))
        yield k, host, path, best[2], best[3]


def exact(docs):
    """Of equal texts the smallest key stays (nulls last); of rows that tie, one."""
    groups: dict[str, list] = {}
    for k, text in docs:
        groups.setdefault(sha(re.sub(r"[\x20\x09-\x0D]+", " ", text or "")), []).append(k)
    for h, keys in groups.items():
        keys.sort(key=lambda k: (k is None, k))
        for i, k in enumerate(keys):
            yield k, keys[0], len(keys), i == 0, h


def phrases(docs, least=100, keep=2000, longest=5, inside=100):
    counts: dict[str, Counter] = {}
    for lang, text in docs:
        f = counts.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            f.update(tuple(w[i: i + m]) for i in range(len(w)) for m in range(1, longest + 1) if i + m <= len(w))
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        longer = Counter()
        for p, a in candidates.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    longer[p[i: i + m]] = max(longer[p[i: i + m]], a)
        rows = []
        for p, a in candidates.items():
            score, k = min((1000 * a * n // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            if not longer[p] or 100 * longer[p] < inside * a:
                rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(rows)[:keep], 1):
            yield lang, rank, p.decode(), -a, left, right, n, -score


def conversations(rows):
    """Damage and repair of (conv_id, turn, role, text), every audit tried turn by turn over the four states."""
    said = lambda x: " " if x is None else str(x)
    kept: dict = {r[0]: [] for r in rows}
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        role, text = said(role), said(text)
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        kept[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    after = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
    names = {"u": "user", "a": "assistant"}
    for conv, mine in kept.items():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = [t for t, _, _ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        seen, faults = set(), []
        for _, role, text in mine:
            end = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else None)
            seen.add((role, text))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        best = {0: (0, "", ())}
        def added(ways):
            out = dict(ways)
            for _ in range(2):
                for s, (c, a, t) in list(out.items()):
                    x = "a" if s == 2 else "u"
                    new = (c + 2, a + "I", t + ((names[x], ""),))
                    to = after[x, s]
                    out[to] = min(out.get(to, new), new, key=lambda w: w[:2])
            return out
        for (_, role, text), fault in zip(mine, faults):
            ways: dict = {}
            def offer(s, w):
                ways[s] = min(ways.get(s, w), w, key=lambda v: v[:2])
            for s, (c, a, t) in added(best).items():
                offer(s, (c + 3, a + "D", t))
                if fault not in ("blank", "duplicate"):
                    extra = int(fault == "truncated")
                    if (role[:1], s) in after:
                        offer(after[role[:1], s], (c + extra, a + "K", t + ((role, text),)))
                    x = "a" if s == 2 else "u"
                    offer(after[x, s], (c + 2 + extra, a + "R", t + ((names[x], text),)))
            best = ways
        c, a, t = min((w for s, w in added(best).items() if s in (0, 3)), key=lambda w: w[:2])
        n = Counter(faults)
        yield (conv, gaps, n["blank"], n["duplicate"], n["truncated"], illegal, c, a, sha("\n".join(f"{r}:{x}" for r, x in t)))
