"""Evidence of one pair by the definition, text by text."""

from plumbline.functions import kernels as K
from plumbline.operators.evidence import FUZZY_TOKENS, LABELS, MULTI_PATTERNS


class Text:
    """One side of a pair: tokens with their places in the normal form."""

    def __init__(self, content: str, stop: frozenset[str]) -> None:
        self.content = content
        self.norm, self.offsets = K.normalize_with_offsets(content)
        self.spans, at = [], 0
        self.tokens = self.norm.split(" ") if self.norm else []
        for t in self.tokens:
            self.spans.append((at, at + len(t)))
            at += len(t) + 1
        kept = [i for i, t in enumerate(self.tokens) if t not in stop]
        self.words, self.word_spans = [self.tokens[i] for i in kept], [self.spans[i] for i in kept]

    def original(self, start: int, end: int) -> tuple[int, int] | None:
        if not 0 <= start < end <= len(self.offsets):
            return None
        return self.offsets[start], min(len(self.content), self.offsets[end - 1] + 1)


def pair_evidence(case_id: str, a: Text, b: Text, shingle: float, settings) -> list[tuple]:
    """Rows in order: exact phrases, the first multi-pattern hit, shingles by
    position, the local alignment."""
    rows: list[tuple] = []

    def add(kind: str, sub: tuple[int, int], ref: tuple[int, int], similarity: float, algorithm: str, excerpt: str) -> None:
        x, y = a.original(*sub), b.original(*ref)
        if x and y:
            rows.append((case_id, len(rows), kind, *x, *y, max(0.0, min(1.0, similarity)), algorithm, excerpt))

    if settings.enable_exact:
        width = max(5, settings.word_shingle_size)
        n = len(a.tokens)
        made = [" ".join(a.tokens[i : i + width]) for i in range(n - width + 1)] if n >= width else [a.norm] if n else []
        eligible: dict[str, int] = {}
        for i, p in enumerate(made):
            if len(p) >= settings.min_exact_phrase_characters:
                eligible.setdefault(p, i)
        for p, i in eligible.items():
            at = b.norm.find(p)
            if at >= 0:
                here = a.norm.find(p)
                add("EXACT", (here, here + len(p)), (at, at + len(p)), 1.0, LABELS[i % 3], p)
        several = list(eligible)[:MULTI_PATTERNS]
        if several:
            hit = next(iter(K.Automaton(several).find(b.norm)), None)
            if hit:
                at, p = hit[0], several[hit[1]]
                here = a.norm.find(p)
                add("MULTI_PATTERN", (here, here + len(p)), (at, at + len(p)), 1.0, "Aho-Corasick", p)
    if settings.enable_shingle:
        w = settings.word_shingle_size
        first: dict[tuple, int] = {}
        for i in range(len(b.words) - w + 1):
            first.setdefault(tuple(b.words[i : i + w]), i)
        for i in range(len(a.words) - w + 1):
            s = tuple(a.words[i : i + w])
            if s in first:
                j = first[s]
                add("SHINGLE", (a.word_spans[i][0], a.word_spans[i + w - 1][1]), (b.word_spans[j][0], b.word_spans[j + w - 1][1]), max(shingle, 0.01), "word-shingle Jaccard", " ".join(s))
    if settings.enable_fuzzy:
        x, y = a.words[:FUZZY_TOKENS], b.words[:FUZZY_TOKENS]
        score, similarity, i, j, k, m = K.local_alignment(x, y)
        if score > 0:
            add("FUZZY", (a.word_spans[i][0], a.word_spans[j - 1][1]), (b.word_spans[k][0], b.word_spans[m - 1][1]), similarity, "Smith-Waterman", " ".join(x[i:j]))
    return rows
