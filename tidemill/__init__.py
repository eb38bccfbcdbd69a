"""tidemill: event-time social-activity analytics and corpus preparation on Spark."""
