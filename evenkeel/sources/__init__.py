from evenkeel.sources.readers import (read_census_csv, read_credit_csv, load_table,
                                      write_table, write_csv)
from evenkeel.sources.views import (doc_audit, order_audit, line_audit, event_audit,
                                    to_long_predictions)

__all__ = ["read_census_csv", "read_credit_csv", "load_table", "write_table", "write_csv",
           "doc_audit", "order_audit", "line_audit", "event_audit", "to_long_predictions"]
