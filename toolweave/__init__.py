"""Spark-native tool-log ETL and fab analytics.

Every public function is ``DataFrame -> DataFrame`` or ``Column -> Column``: nothing here
collects, holds a global session or pulls rows through the driver.
"""
