"""The small corpus whose numbers were worked out by hand."""

A = "https://a.example.com/home"
B = "https://a.example.com/cafe"
C = "https://b.example.org/x"
E = "https://b.example.org/empty"
X = "https://out.example.com/p"
H = "https://c.example.net/hidden"
O = "https://z.example.net/orphan"

PAGES = [(1, A, "Chat noir, chat blanc"), (2, B, "Café d'été"), (3, C, "Le chat du café"), (4, E, "...")]

LINKS = [(A, B), (A, B), (A, C), (B, A), (C, A), (C, X), (C, H), (H, A), (O, B)]

POSTINGS = {
    (1, "chat"): (0.5, 0.346574),
    (1, "noir"): (0.25, 0.346574),
    (1, "blanc"): (0.25, 0.346574),
    (2, "cafe"): (0.333333, 0.231049),
    (2, "d"): (0.333333, 0.462098),
    (2, "ete"): (0.333333, 0.462098),
    (3, "le"): (0.25, 0.346574),
    (3, "chat"): (0.25, 0.173287),
    (3, "du"): (0.25, 0.346574),
    (3, "cafe"): (0.25, 0.173287),
}

RANKS = {A: 0.326933188, B: 0.222762140, C: 0.130131070, E: 0.25, X: 0.074370470, H: 0.074370470}
RANKS_AFTER_5 = {A: 0.321077, B: 0.217952, C: 0.127726, E: 0.25, X: 0.073674, H: 0.073674}

# query: rows of (page_id, score, order_key, n_words) in rank order
SEARCHES = {
    "chat": [(1, 0.127316, 0.127316, 1), (3, 0.064522, 0.064522, 1)],
    "CAFÉ": [(2, 0.089395, 0.089395, 1), (3, 0.064522, 0.064522, 1)],
    "chat chat": [(1, 0.127316, 0.127316, 1), (3, 0.064522, 0.064522, 1)],
    "chat café": [(3, 0.064522, 0.113105, 2)],
    "le chat": [(3, 0.106400, 0.106400, 1), (3, 0.064522, 0.064522, 1)],
    "d été": [(2, 0.141686, 0.257170, 2)],
    "d'été": [],
    "café,": [],
    "chat noir café": [],
    "": [],
}

PAGE_SEARCHES = {"chat café": [(3, 0.113105)], "le chat": [(3, 0.154983)]}
