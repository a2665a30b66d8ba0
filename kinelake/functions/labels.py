"""Label, text and number rules of clips and sessions, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The classes of the data model, in alphabetical order.
SHOTS = ("cover_drive", "defensive_shot", "pull_shot", "sweep_shot")


def shot_of(name: Column) -> Column:
    """Class from a file name; the first rule that fits wins."""
    low = F.lower(name)
    return (
        F.when(low.contains("defensive"), "defensive_shot").when(low.contains("cover"), "cover_drive")
        .when(low.contains("pull"), "pull_shot").when(low.contains("sweep"), "sweep_shot").otherwise("unknown")
    )


def quality_of(name: Column, label: Column | None = None) -> Column:
    """Quality from a file stem; idle clips have none."""
    low = F.lower(name)
    found = F.when(low.contains("good"), "good").when(low.contains("average") | low.contains("avg"), "average").when(low.contains("bad"), "bad").otherwise("unknown")
    return found if label is None else F.when(label == "idle", "none").otherwise(found)


#: Players in the order of their clips.
PLAYERS = ("playerA", "playerB", "playerC", "playerD")


def player_of(stem: Column, label: Column | None = None) -> Column:
    """Player from quality and clip number: two clips a player for good and average, one for bad; idle clips have none."""
    pattern = r"(?i)_(good|average|avg|bad)_(\d+)$"
    kind = F.lower(F.regexp_extract(stem, pattern, 1))
    number = F.regexp_extract(stem, pattern, 2).try_cast("int")
    players = F.array(*[F.lit(x) for x in PLAYERS])
    place = F.when(kind == "bad", number).when(kind != "", F.ceil(number / 2).cast("int"))
    found = F.coalesce(F.when(place.between(1, len(PLAYERS)), F.get(players, place - 1)), F.lit("unknown"))
    return found if label is None else F.when(F.lower(label) == "idle", "unknown").otherwise(found)


def yes(value: Column, lenient: bool = False) -> Column:
    """Exactly yes, or any of yes, y, true, 1."""
    return F.lower(F.trim(value)).isin(*(("yes", "y", "true", "1") if lenient else ("yes",)))


def video_id(value: Column) -> Column:
    """F16: numbers as three digits at least, other text trimmed."""
    number = value.try_cast("double")
    return F.when(number.isNotNull(), F.format_string("%03d", number.cast("long"))).otherwise(F.trim(value))


def boolean(value: Column) -> Column:
    """true, 1, yes / false, 0, no; NULL else."""
    low = F.lower(F.trim(value.cast("string")))
    return F.when(low.isin("true", "1", "yes"), True).when(low.isin("false", "0", "no"), False)


def duration_label(seconds: Column) -> Column:
    """F16: minutes and seconds from 60 on, a dash without a positive duration."""
    whole = F.round(seconds).cast("long")
    return F.when(F.coalesce(seconds, F.lit(0.0)) <= 0, "-").when(whole >= 60, F.format_string("%dm %ds", F.floor(whole / 60), whole % 60)).otherwise(F.format_string("%ds", whole))


def clean_text(text: Column, longest: int = 600) -> Column:
    """white space collapsed; NULL when empty or longer than allowed."""
    tidy = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when((F.length(tidy) > 0) & (F.length(tidy) <= longest), tidy)


def day_key(stamp: Column) -> Column:
    """date in the timestamp's own offset."""
    return F.substring(stamp, 1, 10)


def pseudonym(user: Column) -> Column:
    """first 16 hexadecimal digits of SHA-256."""
    return F.substring(F.sha2(user.cast("string"), 256), 1, 16)


def clip_hash(content: Column) -> Column:
    """SHA-256 of a clip's bytes."""
    return F.sha2(content.cast("binary"), 256)


def band(score: Column) -> Column:
    """F12."""
    return F.when(score >= 90, "strong").when(score >= 75, "solid").when(score >= 60, "needs attention").otherwise("priority issue")


def severity(score: Column) -> Column:
    """F10."""
    return F.when(score < 40, "high").when(score < 65, "medium").otherwise("low")


def direction(actual: Column, low: Column, high: Column) -> Column:
    """F11."""
    return F.when(actual < low, "below").when(actual > high, "above").otherwise("inside")
