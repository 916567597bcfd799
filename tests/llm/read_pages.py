"""Main-body lines of pages of the sf0.1 tables, told by reading them, without any rule of the package.

page_id: (lines of the main body, lines on which a reader could not decide).
"""


def _lines(text: str) -> set[int]:
    """``7 9-11`` as {7, 9, 10, 11}."""
    parts = [p.split("-") for p in text.split()]
    return {n for p in parts for n in range(int(p[0]), int(p[-1]) + 1)}


READ = {
    page: (_lines(main), _lines(open_))
    for page, main, open_ in (
        (762, "7 9-11 13-24 26 28", "27"),
        (4732, "5 7 9-12 14-25", ""),
        (5249, "10 13 15", ""),
        (1717, "8 11 13 15-24", ""),
        (5192, "16 18-21 23-26", "28"),
        (2634, "8 10-12 14-17 19-23", ""),
        (737, "4-13 15-22", ""),
        (5666, "9 12", ""),
        (4728, "13 15-18 20-21", ""),
        (3381, "9 11-16", ""),
        (2722, "10 14-15", ""),
        (50, "2 4 6", ""),
        (5046, "9-10 13", ""),
        (2210, "12 15-25", "26"),
    )
}
