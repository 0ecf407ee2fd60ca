from tracefuse.streaming.live import (fused_verdicts, start_fused_sink, windowed_counts,
                                      windowed_flow_stats)

__all__ = ["fused_verdicts", "start_fused_sink", "windowed_counts", "windowed_flow_stats"]
