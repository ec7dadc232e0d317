"""Double columns of each registered query (rounded on both sides).

Generated from the Spark result schemas by ``python -m latencylab.plans.gen_doubles``;
``tests/test_oracle.py`` checks it is current.
"""

DOUBLE_COLUMNS: dict[str, list[str]] = {'account_batch_cumulative': ['account_total_amount', 'account_avg_amount'],
 'account_metrics': ['total_amount', 'max_amount', 'avg_amount'],
 'account_running': ['account_total_amount', 'account_avg_amount', 'account_max_amount'],
 'aggregate_latency_series': ['throughput_eps',
                              'avg_latency_ms',
                              'median_latency_ms',
                              'p95_latency_ms',
                              'stddev_latency_ms',
                              'stddev_of_run_avg_latency_ms',
                              'max_latency_ms'],
 'aggregate_resource_series': ['avg_memory_working_set_bytes',
                               'max_memory_working_set_bytes',
                               'avg_cpu_usage_cores',
                               'max_cpu_usage_cores',
                               'avg_cpu_usage_percent',
                               'max_cpu_usage_percent'],
 'aggregate_run_table': ['avg_of_run_avg_latency_ms',
                    'avg_of_run_median_latency_ms',
                    'avg_of_run_p95_latency_ms',
                    'avg_of_run_stddev_latency_ms',
                    'stddev_of_run_avg_latency_ms',
                    'max_latency_ms',
                    'avg_of_run_avg_latency_ci95_margin_ms',
                    'avg_of_run_avg_latency_ci95_low_ms',
                    'avg_of_run_avg_latency_ci95_high_ms'],
 'aggregate_runs': ['avg_of_run_avg_latency_ms',
                    'avg_of_run_median_latency_ms',
                    'avg_of_run_p95_latency_ms',
                    'avg_of_run_stddev_latency_ms',
                    'stddev_of_run_avg_latency_ms',
                    'max_latency_ms',
                    'avg_of_run_avg_latency_ci95_margin_ms',
                    'avg_of_run_avg_latency_ci95_low_ms',
                    'avg_of_run_avg_latency_ci95_high_ms'],
 'aggregate_selected': ['avg_of_run_avg_latency_ms',
                        'avg_of_run_median_latency_ms',
                        'avg_of_run_p95_latency_ms',
                        'avg_of_run_stddev_latency_ms',
                        'stddev_of_run_avg_latency_ms',
                        'max_latency_ms',
                        'avg_of_run_avg_latency_ci95_margin_ms',
                        'avg_of_run_avg_latency_ci95_low_ms',
                        'avg_of_run_avg_latency_ci95_high_ms'],
 'bucket_rollup': ['avg_latency_ms', 'median_latency_ms', 'p95_latency_ms', 'max_latency_ms'],
 'ci95_runs': ['avg_latency_ms',
               'stddev_latency_ms',
               'avg_latency_ci95_margin_ms',
               'avg_latency_ci95_low_ms',
               'avg_latency_ci95_high_ms'],
 'clean_nan': ['cpu_seconds_total', 'memory_bytes'],
 'compare_framework_series': ['spark_throughput_eps',
                              'spark_avg_latency_ms',
                              'spark_median_latency_ms',
                              'spark_p95_latency_ms',
                              'spark_stddev_latency_ms',
                              'spark_stddev_of_run_avg_latency_ms',
                              'spark_max_latency_ms',
                              'flink_throughput_eps',
                              'flink_avg_latency_ms',
                              'flink_median_latency_ms',
                              'flink_p95_latency_ms',
                              'flink_stddev_latency_ms',
                              'flink_stddev_of_run_avg_latency_ms',
                              'flink_max_latency_ms'],
 'compare_frameworks': ['spark_avg_of_run_avg_latency_ms',
                        'spark_avg_of_run_median_latency_ms',
                        'spark_avg_of_run_p95_latency_ms',
                        'spark_avg_of_run_stddev_latency_ms',
                        'spark_stddev_of_run_avg_latency_ms',
                        'spark_max_latency_ms',
                        'spark_avg_of_run_avg_latency_ci95_margin_ms',
                        'spark_avg_of_run_avg_latency_ci95_low_ms',
                        'spark_avg_of_run_avg_latency_ci95_high_ms',
                        'flink_avg_of_run_avg_latency_ms',
                        'flink_avg_of_run_median_latency_ms',
                        'flink_avg_of_run_p95_latency_ms',
                        'flink_avg_of_run_stddev_latency_ms',
                        'flink_stddev_of_run_avg_latency_ms',
                        'flink_max_latency_ms',
                        'flink_avg_of_run_avg_latency_ci95_margin_ms',
                        'flink_avg_of_run_avg_latency_ci95_low_ms',
                        'flink_avg_of_run_avg_latency_ci95_high_ms'],
 'compare_runs': ['left_avg_latency_ms',
                  'left_median_latency_ms',
                  'left_p95_latency_ms',
                  'left_stddev_latency_ms',
                  'left_max_latency_ms',
                  'left_avg_latency_ci95_margin_ms',
                  'left_avg_latency_ci95_low_ms',
                  'left_avg_latency_ci95_high_ms',
                  'right_avg_latency_ms',
                  'right_median_latency_ms',
                  'right_p95_latency_ms',
                  'right_stddev_latency_ms',
                  'right_max_latency_ms',
                  'right_avg_latency_ci95_margin_ms',
                  'right_avg_latency_ci95_low_ms',
                  'right_avg_latency_ci95_high_ms',
                  'delta_avg_latency_ms',
                  'delta_p95_latency_ms'],
 'compare_runs_warmup': ['left_avg_latency_ms',
                         'left_median_latency_ms',
                         'left_p95_latency_ms',
                         'left_stddev_latency_ms',
                         'left_max_latency_ms',
                         'left_avg_latency_ci95_margin_ms',
                         'left_avg_latency_ci95_low_ms',
                         'left_avg_latency_ci95_high_ms',
                         'right_avg_latency_ms',
                         'right_median_latency_ms',
                         'right_p95_latency_ms',
                         'right_stddev_latency_ms',
                         'right_max_latency_ms',
                         'right_avg_latency_ci95_margin_ms',
                         'right_avg_latency_ci95_low_ms',
                         'right_avg_latency_ci95_high_ms',
                         'delta_avg_latency_ms',
                         'delta_p95_latency_ms'],
 'compare_two_runs': ['left_avg_latency_ms',
                      'left_median_latency_ms',
                      'left_p95_latency_ms',
                      'left_stddev_latency_ms',
                      'left_max_latency_ms',
                      'left_avg_latency_ci95_margin_ms',
                      'left_avg_latency_ci95_low_ms',
                      'left_avg_latency_ci95_high_ms',
                      'right_avg_latency_ms',
                      'right_median_latency_ms',
                      'right_p95_latency_ms',
                      'right_stddev_latency_ms',
                      'right_max_latency_ms',
                      'right_avg_latency_ci95_margin_ms',
                      'right_avg_latency_ci95_low_ms',
                      'right_avg_latency_ci95_high_ms',
                      'delta_avg_latency_ms',
                      'delta_p95_latency_ms'],
 'counter_rate': ['cpu_usage_cores'],
 'decode_collected': ['latency_ms'],
 'docker_resource_total': ['memory_working_set_bytes'],
 'enriched_running': ['window_total_amount',
                      'window_avg_amount',
                      'account_total_amount',
                      'account_avg_amount'],
 'enriched_running_event': ['window_total_amount',
                            'window_avg_amount',
                            'account_total_amount',
                            'account_avg_amount',
                            'account_max_amount'],
 'event_envelope': ['TransactionAmount', 'AccountBalance'],
 'fault_attempt_sections': ['avg_latency_ms', 'max_latency_ms', 'median_latency_ms', 'p95_latency_ms'],
 'fault_latency_sections': ['avg_latency_ms', 'max_latency_ms', 'median_latency_ms', 'p95_latency_ms'],
 'fault_timeline': ['elapsed_seconds'],
 'gap_stats': ['typical_gap_ms'],
 'latency_enrich': ['stored_latency_ms'],
 'latency_histogram': ['le'],
 'latency_series': ['throughput_eps',
                    'avg_latency_ms',
                    'median_latency_ms',
                    'p95_latency_ms',
                    'stddev_latency_ms',
                    'max_latency_ms'],
 'latency_series_bucket': ['throughput_eps',
                           'avg_latency_ms',
                           'median_latency_ms',
                           'p95_latency_ms',
                           'stddev_latency_ms',
                           'max_latency_ms'],
 'latency_series_raw': ['throughput_eps',
                        'avg_latency_ms',
                        'median_latency_ms',
                        'p95_latency_ms',
                        'stddev_latency_ms',
                        'max_latency_ms'],
 'lenient_events': ['TransactionAmount'],
 'metric_align': ['value'],
 'output_records': ['TransactionAmount',
                    'AccountBalance',
                    'window_total_amount',
                    'window_avg_amount',
                    'account_total_amount',
                    'account_avg_amount'],
 'parse_events': ['TransactionAmount', 'AccountBalance'],
 'payload_defaults': ['TransactionAmount'],
 'rate_avg_latency': ['latency_sum', 'avg_latency_ms'],
 'replay_sample': ['value'],
 'resource_merge': ['memory_working_set_bytes', 'cpu_usage_cores'],
 'resource_overview': ['avg_cores', 'max_cores'],
 'resource_series': ['avg_memory_working_set_bytes',
                     'max_memory_working_set_bytes',
                     'avg_cpu_usage_cores',
                     'max_cpu_usage_cores',
                     'avg_cpu_usage_percent',
                     'max_cpu_usage_percent'],
 'run_events_one': ['latency_ms'],
 'run_events_scan': ['latency_ms'],
 'run_list': ['eps', 'duration_seconds', 'avg_latency_ms', 'p95_latency_ms'],
 'run_list_filtered': ['eps', 'duration_seconds', 'avg_latency_ms', 'p95_latency_ms'],
 'run_rollup': ['avg_latency_ms', 'median_latency_ms', 'p95_latency_ms', 'max_latency_ms'],
 'run_sources': ['avg_latency_ms', 'p95_latency_ms'],
 'run_start_alignment': ['eps'],
 'run_summary': ['avg_latency_ms',
                 'median_latency_ms',
                 'p95_latency_ms',
                 'stddev_latency_ms',
                 'max_latency_ms',
                 'avg_latency_ci95_margin_ms',
                 'avg_latency_ci95_low_ms',
                 'avg_latency_ci95_high_ms'],
 'run_summary_bucket': ['avg_latency_ms',
                        'median_latency_ms',
                        'p95_latency_ms',
                        'stddev_latency_ms',
                        'max_latency_ms',
                        'avg_latency_ci95_margin_ms',
                        'avg_latency_ci95_low_ms',
                        'avg_latency_ci95_high_ms'],
 'run_summary_warmup': ['avg_latency_ms',
                        'median_latency_ms',
                        'p95_latency_ms',
                        'stddev_latency_ms',
                        'max_latency_ms',
                        'avg_latency_ci95_margin_ms',
                        'avg_latency_ci95_low_ms',
                        'avg_latency_ci95_high_ms'],
 'scenario_volume': ['eps', 'duration_seconds', 'completeness'],
 'upsert_latest_wins': ['avg_latency_ms', 'median_latency_ms', 'p95_latency_ms', 'max_latency_ms'],
 'window_metrics': ['total_amount', 'avg_amount'],
 'window_running': ['window_total_amount', 'window_avg_amount']}
