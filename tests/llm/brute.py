"""Plain Python versions of what the operators compute."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def shingles(text, k=5):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return set()
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} or {tuple(w)}


def near_components(texts):
    """doc_id -> smallest id reachable over links of similarity 0.75 or more."""
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    held = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            held[g].append(i)
    for pair in {(a, b) for ids in held.values() for a in ids for b in ids if a < b}:
        x, y = sets[pair[0]], sets[pair[1]]
        if 100 * len(x & y) >= 75 * len(x | y):
            a, b = find(pair[0]), find(pair[1])
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}, {i: len(s) for i, s in sets.items()}


def base_counts(text):
    text = text or ""
    w = words(text)
    windows = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    repeated = {i + j for i in range(len(w) - 2) if windows[tuple(w[i:i + 3])] > 1 for j in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated)


def spelling_variants(rows):
    """word -> (form, root, n, n_near, form_n), by comparing all words."""
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    n = {w: k for w, k in counts.items() if k >= 3 and len(w) >= 5}
    near = {w: [o for o in n if _one_edit(w, o)] for w in n}
    form = {w: min(near[w], key=lambda o: (-n[o], o), default=None) for w in n}
    form = {w: o if o is not None and n[o] >= 2 * n[w] else None for w, o in form.items()}

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n}


def _one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def alignments(rows, path_a, path_b):
    """Per row what its tokens' alignment gives, by comparing all pairs of tokens."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(path_a)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=path_b)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(x): x for x in printable}
    back |= {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in printable)}

    def piece(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()

    docs, counts = [], Counter()
    for _, text in rows:
        raw = (" " + (text or "")).encode()
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a = [bytes(back[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [piece(i) for i in ids_b]
        if not text or b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
            docs.append(None)
            continue
        ends_a, ends_b = ([sum(map(len, x[:k + 1])) for k in range(len(x))] for x in (bytes_a, bytes_b))
        both = sorted(set(ends_a) & set(ends_b))
        groups = ";".join(",".join(str(i) for i, e in zip(ids_a, ends_a) if lo < e <= hi) + "|"
                          + ",".join(str(i) for i, e in zip(ids_b, ends_b) if lo < e <= hi)
                          for lo, hi in zip([0, *both], both))
        links = [(x, y) for x, e, s in zip(ids_a, ends_a, [0, *ends_a]) for y, f, t in zip(ids_b, ends_b, [0, *ends_b])
                 if max(s, t) < min(e, f)]
        counts.update(links)
        docs.append((len(ids_a), len(ids_b), len(both), links, hashlib.sha256(groups.encode()).hexdigest()))
    most = {}
    for (_, y), n in counts.items():
        most[y] = max(most.get(y, 0), n)
    return [(i, *(0,) * 6, "") if d is None else
            (i, *d[:3], len(d[3]), sum(counts[x] == most[x[1]] for x in d[3]), sum(counts[x] for x in d[3]), d[4])
            for (i, _), d in zip(rows, docs)]
