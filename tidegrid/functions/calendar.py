"""Calendar features of a date and an hour of day, given as column names or SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rush hours, hours of each part of the day, work hours, cycle lengths.
MORNING_RUSH = [7, 8, 9]
EVENING_RUSH = [17, 18, 19]
PARTS_OF_DAY = {"night": (0, 5), "morning": (6, 11), "afternoon": (12, 17), "evening": (18, 23)}
WORK_HOURS = (8, 18)
CYCLES = {"hour": 24, "day_of_week": 7, "month": 12}


def flag(condition: str) -> Column:
    """1 where the SQL condition holds, 0 where it does not or is unknown."""
    return F.expr(f"CAST(coalesce({condition}, false) AS INT)")


def one_of(column: str, values: list[int]) -> str:
    return f"{column} IN ({', '.join(map(str, values))})"


def parse_date(text: str, pattern: str = "dd/MM/yyyy") -> Column:
    return F.to_date(text, pattern)


def date_parts(date: str = "date") -> dict[str, Column]:
    """Monday is 0."""
    return {
        "day_of_week": F.expr(f"weekday({date})"),
        "month": F.expr(f"month({date})"),
        "day_of_month": F.expr(f"day({date})"),
    }


def weekend_flags(date: str = "date") -> dict[str, Column]:
    return {"is_weekend": flag(f"weekday({date}) >= 5"), "is_weekday": flag(f"weekday({date}) < 5")}


def cyclical(value: str, period: int, name: str) -> dict[str, Column]:
    angle = f"2 * pi() * {value} / {period}"
    return {f"{name}_sin": F.expr(f"sin({angle})"), f"{name}_cos": F.expr(f"cos({angle})")}


def cycles(date: str = "date", hour: str | None = "hour") -> dict[str, Column]:
    """Position in the day (if there is an hour), the week and the year."""
    daily = cyclical(hour, CYCLES["hour"], "hour") if hour else {}
    return (
        daily
        | cyclical(f"weekday({date})", CYCLES["day_of_week"], "day_of_week")
        | cyclical(f"month({date})", CYCLES["month"], "month")
    )


def rush_hour_flags(hour: str = "hour") -> dict[str, Column]:
    return {
        "is_morning_rush": flag(one_of(hour, MORNING_RUSH)),
        "is_evening_rush": flag(one_of(hour, EVENING_RUSH)),
        "is_rush_hour": flag(one_of(hour, MORNING_RUSH + EVENING_RUSH)),
    }


def part_of_day_flags(hour: str = "hour") -> dict[str, Column]:
    return {
        f"time_of_day_{part}": flag(f"{hour} BETWEEN {first} AND {last}")
        for part, (first, last) in PARTS_OF_DAY.items()
    }


def work_hour_flag(date: str = "date", hour: str = "hour") -> dict[str, Column]:
    first, last = WORK_HOURS
    return {"is_work_hour": flag(f"{hour} BETWEEN {first} AND {last} AND weekday({date}) < 5")}


def calendar_features(date: str = "date", hour: str = "hour") -> dict[str, Column]:
    """All nineteen, in the order of the feature table."""
    return (
        date_parts(date) | weekend_flags(date) | cycles(date, hour) | rush_hour_flags(hour)
        | part_of_day_flags(hour) | work_hour_flag(date, hour)
    )


def date_range(df: DataFrame, date: str, by: list[str]) -> DataFrame:
    """First and last date per group, for example per split."""
    return df.groupBy(*by).agg(F.min(date).alias("first_date"), F.max(date).alias("last_date"))
