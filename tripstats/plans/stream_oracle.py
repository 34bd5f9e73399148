"""DuckDB twins of the change-feed queries: the final state of each stream
equals the batch rollup of the same feed."""
from tripstats.plans.oracle import r6

STREAM_SQL = {
    "to_messages": """
        SELECT 'etl.public.temp_table' AS topic,
               CAST(to_json(struct_pack(pickup_date := CAST(pickup_date - DATE '1970-01-01' AS INTEGER),
                                        pickup_hour := CAST(pickup_hour AS BIGINT),
                                        pickup_days := pickup_days,
                                        count_trip := count_trip)) AS VARCHAR) AS value
        FROM month_partials""",
    "cdc_unwrap": """
        SELECT pickup_date, CAST(pickup_hour AS BIGINT) AS pickup_hour, pickup_days, count_trip
        FROM month_partials
        UNION ALL
        SELECT pickup_date, CAST(pickup_hour AS BIGINT), pickup_days, count_trip + 1
        FROM month_partials WHERE pickup_hour % 2 = 0""",
    "topic_replay": f"""
        SELECT CAST(pickup_hour AS BIGINT) AS pickup_hour, {r6('avg_fare_per_km')} AS avg_fare_per_km,
               {r6('avg_tip_amount')} AS avg_tip_amount, short_trip_count, long_trip_count
        FROM profile""",
    "stream_daily": "SELECT pickup_date, pickup_days, total_trip FROM daily",
    "stream_duration": """
        SELECT duration_interval, duration_interval_class, CAST(sum(trip_count) AS BIGINT) AS trip_count
        FROM histogram GROUP BY duration_interval, duration_interval_class""",
    "stream_routes": "SELECT * FROM route_means",
    "stream_fare": f"""
        SELECT CAST(pickup_hour AS BIGINT) AS pickup_hour, {r6('avg_fare_per_km')} AS avg_fare_per_km,
               {r6('avg_tip_amount')} AS avg_tip_amount, short_trip_count, long_trip_count
        FROM profile""",
}
