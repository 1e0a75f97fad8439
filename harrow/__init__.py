"""harrow: Spark-native training-data selection and rollout analytics."""
