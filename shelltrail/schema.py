"""Column layouts shared by all operators."""

# One row per command. ``number`` is unique in a history and gives its order.
COMMANDS = "history_id string, number bigint, epoch_s bigint, has_time boolean, command string"

# One row per raw text line; ``pos`` is unique in a history and gives its order.
HISTORY_LINES = "history_id string, pos bigint, value string"

# One row per history, kind ('dedup' or 'explain') and, if the prompt had several, part:
# a column ``part_no bigint`` may follow. ``status`` is 'ok' or 'failed'.
RESPONSES = "history_id string, kind string, status string, body string"
