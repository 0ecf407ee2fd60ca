from tracefuse.sources.readers import (parse_sysdig, read_csv, read_manifest, read_packets,
                                       read_strace_logs, read_sysdig, read_tagged_tables,
                                       require_rows)
from tracefuse.sources.sinks import write_table

__all__ = ["parse_sysdig", "read_csv", "read_manifest", "read_packets", "read_strace_logs",
           "read_sysdig", "read_tagged_tables", "require_rows", "write_table"]
