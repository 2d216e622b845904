"""Plain versions of the operators, for small inputs."""
from __future__ import annotations

import re
from collections import defaultdict

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingle_set(text: str | None, width: int) -> frozenset:
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return frozenset()
    width = min(width, len(words))
    return frozenset(tuple(words[i:i + width]) for i in range(len(words) - width + 1))


def near_duplicates(docs: list[tuple[int, str | None]], width: int, percent: int) -> dict[int, tuple[int, int]]:
    """id -> (size of its set, smallest id of its component), by comparing every pair of different sets."""
    sets = {d: shingle_set(t, width) for d, t in docs}
    groups = defaultdict(list)
    for d, s in sets.items():
        if s:
            groups[s].append(d)
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def link(x, y):
        x, y = find(x), find(y)
        parent[max(x, y)] = min(x, y)

    for same in groups.values():
        for d in same:
            link(same[0], d)
    classes = sorted(((s, min(v)) for s, v in groups.items()), key=lambda c: len(c[0]))
    for i, (s, a) in enumerate(classes):
        for t, b in classes[i + 1:]:
            if 100 * len(s) < percent * len(t):
                break
            common = len(s & t)
            if 100 * common >= percent * (len(s) + len(t) - common):
                link(a, b)
    return {d: (len(sets[d]), find(d)) for d in sets}


def base_secrets(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three known forms."""
    text, out = text or "", []
    assign = re.compile(r"""((?:p|P)(?:a|A)(?:s|S)(?:s|S)(?:w|W)(?:o|O)(?:r|R)(?:d|D)|(?:p|P)(?:a|A)(?:s|S)(?:s|S)(?:w|W)(?:d|D)|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for m in assign.finditer(text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    for kind, pattern, least in ((1, r"AKIA[A-Z0-9]+", 20), (2, r"[0-9a-f]+", 24)):
        out += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return sorted(out)
