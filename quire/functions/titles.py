"""Title rules: front and back matter, defaults."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Title words that mark front and back matter.
FRONT_WORDS = [
    "table of contents", "toc", "contents", "copyright", "dedication", "foreword", "forward",
    "preface", "acknowledgments?", "acknowledgements?", "introduction",
]
BACK_WORDS = [
    "about the author", "about author", "also by", "advertisements?", "epilogue", "afterword",
    "appendix", "appendices", "glossary", "index", "endnotes?", "notes", "bibliography", "references",
]


def word_pattern(words: list[str]) -> str:
    return r"\b(" + "|".join(words) + r")\b"


def _matches(title: Column, words: list[str]) -> Column:
    return F.coalesce(F.lower(title).rlike(word_pattern(words)), F.lit(False))


def is_front_matter(title: Column) -> Column:
    return _matches(title, FRONT_WORDS)


def is_back_matter(title: Column) -> Column:
    return _matches(title, BACK_WORDS)
