"""Parameter record for the text → characters → blocks plans.

The defaults are the settings of the original extraction task (Japanese
encyclopedia pages); the driver-table fixtures override the page-specific
ones (title marker, footer headings, header cut) because those pages are
invented prose in European languages.
"""

from __future__ import annotations

from dataclasses import dataclass, replace


# --- fixed values that must equal the original task's -----------------------
# Title marker searched in the raw lines (first line that contains it).
TITLE_MARKER = " - Wikipedia Dump"
# Footer trigger: a line containing this text ...
FOOTER_REGEX = "」から取得"
# ... or a line equal to one of these headings (with their newline).
FOOTER_HEADINGS = ("脚注\n", "参考文献\n", "外部リンク\n", "関連項目\n")
# Lines with line_id <= HEADER_LAST are boilerplate and dropped.
HEADER_LAST = 26
# Tag alphabet and its index.
BIO_TAGS = ("B", "I", "O")
BIO_INDEX = {"B": 0, "I": 1, "O": 2}
# Label value for positions that carry no tag (specials, padding).
IGNORE_LABEL = -1
# Split sizes: first 900 shuffled pages train, next 50 valid, rest test.
N_TRAIN = 900
N_VALID = 50
SPLIT_SEED = 0
# Early stopping patience (epochs without strict improvement).
PATIENCE = 10
# Model length limits: code-point model 2048, vocabulary model 512.
MAX_LENGTH_CODEPOINT = 2048
MAX_LENGTH_VOCAB = 512
# ------------------------------------------------------------------------------

# A page is named by its category and its id: every category is a run of its own.
PAGE = ["category", "page_id"]


@dataclass(frozen=True)
class TextParams:
    """How pages become lines, kept characters and blocks.

    mode:        "char" → fixed-size blocks across lines; "line" → one block per line
    max_length:  model length; block capacity is derived by ``capacity``
    variant:     "vocab" (wrapped [CLS] … [SEP]) or "codepoint" ([CLS] only)
    header_last: drop lines with line_id <= header_last (-1 = keep all)
    """

    title_marker: str = TITLE_MARKER
    footer_regex: str = FOOTER_REGEX
    footer_headings: tuple[str, ...] = FOOTER_HEADINGS
    header_last: int = HEADER_LAST
    mode: str = "char"
    variant: str = "codepoint"
    max_length: int = MAX_LENGTH_CODEPOINT
    blank_patterns: bool = True

    @property
    def capacity(self) -> int:
        # The code-point variant packs one more char per block in char mode
        # (it has no trailing [SEP]); line mode and the vocabulary variant
        # reserve two positions.
        if self.mode == "char" and self.variant == "codepoint":
            return self.max_length - 1
        return self.max_length - 2

    def with_(self, **kw) -> "TextParams":
        return replace(self, **kw)


# Bindings for the driver tables (documents): see FIXTURES.md §G.
FIXTURE_FOOTER_HEADING = "The and attion to thanedble the, anea. Eriner thanea.\n"
FIXTURE_TITLE_MARKER = ". "


def fixture_params(**kw) -> TextParams:
    base = TextParams(
        title_marker=FIXTURE_TITLE_MARKER,
        footer_headings=FOOTER_HEADINGS + (FIXTURE_FOOTER_HEADING,),
        header_last=0,
    )
    return base.with_(**kw)
