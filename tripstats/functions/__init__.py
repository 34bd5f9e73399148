from tripstats.functions.columns import (  # noqa: F401
    bucket_label, cents, duration_bucket, duration_seconds, exact_mean, label_start, mean_of_means, miles_to_km,
    net_of_tip, presented, rounded_mean, weekday_name, weekday_rank, year_range,
)
