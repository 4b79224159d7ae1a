"""Label and key clean-up."""

from pyspark.sql import Column, functions as F

# Characters of a chart label and what replaces them. The source
# characters without a counterpart at the same place in LABEL_TO are dropped.
LABEL_FROM = '"[]{}|\n<>#;\r'
LABEL_TO = "'()()- "
LABEL_LENGTH = 30
LABEL_CUT = 27

# Fixed value: stands for an event without a name in labels and paths.
UNNAMED = "(unnamed)"


def chart_label(text: Column) -> Column:
    """Event name made safe inside a flowchart label, at most 30 characters."""
    safe = F.replace(F.translate(text, LABEL_FROM, LABEL_TO), F.lit("&"), F.lit("and"))
    cut = F.concat(F.substring(safe, 1, LABEL_CUT), F.lit("..."))
    return F.when(F.length(safe) > LABEL_LENGTH, cut).otherwise(safe)


def shown_name(name: Column) -> Column:
    """Event name as it stands in labels and paths."""
    return F.coalesce(name, F.lit(UNNAMED))


def user_key(user: Column) -> Column:
    """User id usable as one path component."""
    return F.translate(user, "/\\", "__")
