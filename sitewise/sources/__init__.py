"""Readers, writers and the stand-in views built from the driver tables."""

from sitewise.sources.readers import (  # noqa: F401
    OBS_SCHEMA, WEATHER_SCHEMA, GROUPS_SCHEMA, TRAITS_SCHEMA,
    ANNUAL_SCHEMA, FORTNIGHTLY_SCHEMA, DATASETS,
    read_observations, clean_observations, read_dimension, read_weather,
    read_traits, trim_trait_code, read_annual_series, read_fortnightly_series,
    write_report,
)
