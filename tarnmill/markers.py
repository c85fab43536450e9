"""Fixed symbols and ids shared by the tokenising and sequence modules."""

from __future__ import annotations

# Marker spellings.
INDENT = "<INDENT>"
DEDENT = "<DEDENT>"
BEGIN_COMMENT = "<COMMENT>"
END_COMMENT = "</COMMENT>"
NEWLINE = "<NEWLINE>"
BEGIN_FILE = "<BOF>"
END_FILE = "<EOF>"
MISSING = "<MISSING>"
END_LINE = "<EOL>"
UNKNOWN = "<unk>"
BEGIN_TEXT = "<s>"
END_TEXT = "</s>"
PADDING = "<pad>"
WORD_START = "▁"

# Ids of the control symbols, and the order of the markers after them.
CONTROL_IDS = {UNKNOWN: 0, BEGIN_TEXT: 1, END_TEXT: 2, PADDING: 3}
MARKER_ORDER = [INDENT, DEDENT, BEGIN_COMMENT, END_COMMENT, NEWLINE, BEGIN_FILE, END_FILE, MISSING]

# Label id that the loss ignores, and default sizes.
IGNORED_LABEL = -100
MAX_CONTEXT_LENGTH = 432
MAX_TARGET_LENGTH = 80
NUM_TARGET_LINES = 2
BLOCK_SIZE = 512


def reserved_symbols(num_reserved: int = 0) -> list[str]:
    """Symbols with fixed ids, in id order.

    The end-of-line marker gets an id of its own after the reserved ones, so that it
    is never confused with the unknown piece.
    """
    control = sorted(CONTROL_IDS, key=CONTROL_IDS.get)
    return control + MARKER_ORDER + [f"<RES{i}>" for i in range(num_reserved)] + [END_LINE]
